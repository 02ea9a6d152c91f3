"""tremor: text-robustness analytics as Spark DataFrame transforms."""

from tremor.shipping import ship  # noqa: F401
