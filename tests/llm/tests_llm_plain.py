"""Plain versions that the pipeline's stages are held against."""


def _one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[p + 1:] == (b[p + 1:] if len(a) == len(b) else b[p:])


def brute_lines(rows, min_words=5):
    """Texts by id without lines that an earlier line equals or is one word edit away from."""
    lines = sorted((k, p, line) for k, t in rows if t is not None for p, line in enumerate(t.split("\n")))
    out, exact, by_size = {k: None if t is None else [] for k, t in rows}, set(), {}
    for k, p, line in lines:
        words = [w for w in line.split(" ") if w]
        gone = bool(words) and tuple(words) in exact
        if words and not gone:
            near = [w for n in (len(words) - 1, len(words), len(words) + 1) if max(n, len(words)) >= min_words for w in by_size.get(n, ())]
            gone = any(_one_edit(words, w) for w in near)
            exact.add(tuple(words))
            by_size.setdefault(len(words), []).append(words)
        if not gone:
            out[k].append(line)
    return {k: None if v is None else "\n".join(v) for k, v in out.items()}


def near_groups(rows, bits=2):
    """Smallest id of every group of fingerprints that links of up to `bits` connect."""
    todo, kept = dict(rows), set()
    while todo:
        first = min(todo)
        front = [todo.pop(first)]
        kept.add(first)
        while front:
            f = front.pop()
            near = [k for k, g in todo.items() if (f ^ g).bit_count() <= bits]
            front += [todo.pop(k) for k in near]
    return kept
