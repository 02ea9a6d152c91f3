"""Import every module that registers queries."""

from tremor.plans import experiment, q_analysis, q_files, q_score, q_stream, q_text  # noqa: F401
