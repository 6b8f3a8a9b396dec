"""Differences of texts by lines: the shortest edit script, as unified hunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 3
#: Characters of texts whose differences are made before they leave the Python worker.
CHARS = 1_000_000
#: What line_diff adds.
DIFF = pa.struct({"removed": pa.int64(), "added": pa.int64(), "hunks": pa.list_(pa.string())})


def middle(a: Sequence[int], b: Sequence[int]) -> tuple[int, int, int, int]:
    """A run of equal elements, (x, y) to (u, v), that lies halfway on a shortest path from a to b; it may be empty. Paths are
    walked from both ends, a step of one difference at a time, until they meet; two rows of ends are held."""
    n, m = len(a), len(b)
    apart = n - m
    ahead, back = {1: 0}, {1: 0}

    def reach(ends: dict[int, int], k: int, d: int) -> int:
        return ends[k + 1] if k == -d or k != d and ends[k - 1] < ends[k + 1] else ends[k - 1] + 1

    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = u = reach(ahead, k, d)
            while u < n and u - k < m and a[u] == b[u - k]:
                u += 1
            ahead[k] = u
            if apart % 2 and abs(apart - k) < d and u + back[apart - k] >= n:
                return x, x - k, u, u - k
        for k in range(-d, d + 1, 2):
            x = u = reach(back, k, d)
            while u < n and u - k < m and a[n - 1 - u] == b[m - 1 - (u - k)]:
                u += 1
            back[k] = u
            if not apart % 2 and abs(apart - k) <= d and u + ahead[apart - k] >= n:
                return n - u, m - (u - k), n - x, m - (x - k)
    raise AssertionError("paths from both ends meet")


def kept(a: Sequence[int], b: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence, in order; parts still to do are held on a stack."""
    parts = [(0, len(a), 0, len(b))]
    while parts:
        i, j, k, l = parts.pop()  # noqa: E741
        if k == -1:
            yield i, j
            continue
        while i < j and k < l and a[i] == b[k]:
            yield i, k
            i, k = i + 1, k + 1
        tail = 0
        while i < j - tail and k < l - tail and a[j - 1 - tail] == b[l - 1 - tail]:
            tail += 1
        parts += [(j - 1 - s, l - 1 - s, -1, 0) for s in range(tail)]
        j, l = j - tail, l - tail  # noqa: E741
        if i < j and k < l:
            x, y, u, v = middle(a[i:j], b[k:l])
            parts.append((i + u, j, k + v, l))
            parts += [(i + x + s, k + y + s, -1, 0) for s in reversed(range(u - x))]
            parts.append((i, i + x, k, k + y))


def hunks(old: str | None, new: str | None, context: int = CONTEXT) -> tuple[int, int, list[str]]:
    """(lines taken out, lines put in, unified hunks). Lines that only one text has are no part of the search."""
    a, b = ((t or "").split("\n") if t else [] for t in (old, new))
    shared = {line: i for i, line in enumerate(set(a) & set(b))}
    at_a, at_b = ([i for i, line in enumerate(lines) if line in shared] for lines in (a, b))
    pairs = [(at_a[i], at_b[j]) for i, j in kept([shared[a[i]] for i in at_a], [shared[b[j]] for j in at_b])]
    steps, i, j = [], 0, 0
    for x, y in [*pairs, (len(a), len(b))]:
        steps += [("-", a[k], k, j) for k in range(i, x)] + [("+", b[k], x, k) for k in range(j, y)]
        if x < len(a):
            steps.append((" ", a[x], x, y))
        i, j = x + 1, y + 1
    changed = [k for k, s in enumerate(steps) if s[0] != " "]
    out, k = [], 0
    while k < len(changed):
        first = last = changed[k]
        while k < len(changed) and changed[k] - last <= 2 * context + 1:
            last, k = changed[k], k + 1
        part = steps[max(0, first - context) : last + context + 1]
        n, m = sum(s[0] != "+" for s in part), sum(s[0] != "-" for s in part)
        begin = lambda at, size: f"{at + (size > 0)}" + (f",{size}" if size != 1 else "")
        out.append(f"@@ -{begin(part[0][2], n)} +{begin(part[0][3], m)} @@\n" + "\n".join(s[0] + s[1] for s in part))
    return sum(s[0] == "-" for s in steps), sum(s[0] == "+" for s in steps), out


def line_diff(pairs: DataFrame, old: Column, new: Column, context: int = CONTEXT) -> DataFrame:
    """pairs with diff, struct<removed, added, hunks>: the fewest lines that turn old into new.

    Equal texts have no hunks; a null text is an empty one, which has no lines. Texts are read one by one from an
    Arrow batch, and differences leave after CHARS characters, so a worker holds a batch and few of them."""
    chars = CHARS

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for olds, news in batches:
            own, held = [], 0
            for old_text, new_text in zip(olds, news, strict=True):
                x, y = old_text.as_py(), new_text.as_py()
                own.append(dict(zip(("removed", "added", "hunks"), hunks(x, y, context), strict=True)))
                held += len(x or "") + len(y or "")
                if held > chars:
                    yield pa.array(own, DIFF)
                    own, held = [], 0
            yield pa.array(own, DIFF)

    return pairs.withColumn("diff", F.arrow_udf(run, "removed long, added long, hunks array<string>", F.ArrowUDFType.SCALAR_ITER)(old, new))
