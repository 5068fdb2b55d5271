"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths find the n-grams that a text says more than once; what counts
is how many of its characters lie inside them, and inside lines that it has already had. A window of
n + 1 words can only repeat where both its windows of n do, so only the shortest length looks at every
word and each longer one at what the shorter one left.

Null and empty texts have no words and fail the base rule. The rows of a table are judged one by one:
repeated rows get equal verdicts, and no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import textbuf as tb
from loomgraph.llm.common import keep_runs, map_runs

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
DOC_STEP = tb.U64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Rules:
    """Largest shares of a text's word characters that may lie in repeated n-grams, by n, and in repeated lines.

    They are looser than those usual for web pages, as a text that quotes one of its own lines is no junk.
    """

    grams: dict[int, float] = field(default_factory=lambda: {5: 0.30, 6: 0.29, 7: 0.28, 8: 0.27, 9: 0.26, 10: 0.25})
    lines: float = 0.25
    base_gram: int = 8
    min_words: int = 20
    base_share: int = 30


def repeated(keys: np.ndarray, later: bool = False) -> np.ndarray:
    """Which keys occur more than once; with later, without the first of each."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    if later:
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        out = np.zeros(len(keys), bool)
        out[order[1:][s[1:] == s[:-1]]] = True
        return out
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def repeated_windows(words: tb.Words, hashes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size, ascending, the first words of the windows that a document has more than once."""
    n, last, at = len(hashes), None, None
    doc = words.docs.astype(tb.U64) * DOC_STEP
    for k in sizes:
        good = tb.inside(words.offs, k, n)
        if last is None:
            at = np.flatnonzero(good)
        else:
            m = max(0, n - k + 1)
            seen = np.zeros(n + 1, bool)
            seen[at] = True
            at = at[at < m]
            at = at[good[at]]
            for j in range(1, k - last + 1):
                at = at[seen[at + j]]
        key = hashes[at] * tb.STEPS[0]
        for j in range(1, k):
            key += hashes[at + j] * tb.STEPS[j]
        at = at[repeated(tb.mix(key + doc[at]))]
        last = k
        yield k, at


def covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in the windows of k words that start at these places."""
    if not len(at):
        return np.zeros(n, bool)
    edge = np.bincount(at, minlength=n + 1) - np.bincount(at + k, minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0


def measure(run: tb.Run, rules: Rules) -> dict[str, np.ndarray]:
    words = run.words(tb.PLAIN)
    n, offs = len(words), words.offs
    h = words.hashes(False)
    letters = np.zeros(len(run.data) + 1, np.int64)
    np.cumsum(words.is_word & ((run.data & 0xC0) != 0x80), out=letters[1:])
    word_chars = letters[run.offs[1:]] - letters[run.offs[:-1]]
    long = letters[words.ends] - letters[words.starts]

    def by_doc(x: np.ndarray) -> np.ndarray:
        sums = np.zeros(n + 1, np.int64)
        np.cumsum(x, out=sums[1:])
        return sums[offs[1:]] - sums[offs[:-1]]

    out = {"n_words": words.counts, "word_chars": word_chars, "n_symbols": run.per_doc(SYMBOLS[run.data])}
    starts, ends, doc = run.lines()
    full = letters[ends] > letters[starts]
    starts, ends, doc = starts[full], ends[full], doc[full]
    again = repeated(tb.mix(run.span_hash(starts, ends, False) + doc.astype(tb.U64) * DOC_STEP), later=True)
    out["n_dup_lines"] = np.bincount(doc[again], minlength=run.n)
    line_chars = np.bincount(doc[again], weights=(letters[ends] - letters[starts])[again], minlength=run.n)

    share = lambda x: np.divide(x, word_chars, out=np.zeros(run.n), where=word_chars > 0)
    bad = share(line_chars) > rules.lines
    out["dup_line_share"] = share(line_chars)
    for k, at in repeated_windows(words, h, sorted({*rules.grams, rules.base_gram})):
        inside = covered(at, k, n)
        if k == rules.base_gram:
            out["n_repeat_words"] = by_doc(inside)
        if k in rules.grams:
            out[f"gram{k}_share"] = share(by_doc(np.where(inside, long, 0)))
            bad |= out[f"gram{k}_share"] > rules.grams[k]
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.base_share * out["n_words"])
    out["kept"] = ~(out["base_failed"] | bad)
    return out


def repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules | None = None) -> DataFrame:
    """Base counts, shares of characters inside repeated n-grams and lines, and the verdict, a row for each row of df.

    A text is kept if it has min_words words, at most base_share per cent of its words lie in repeated
    windows of base_gram words, and no share exceeds its limit. An empty table gives an empty one.
    """
    rules = rules or Rules()
    long, real, yes = T.LongType(), T.DoubleType(), T.BooleanType()
    fields = [(c, long) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields += [("base_failed", yes), ("kept", yes), ("dup_line_share", real), *((f"gram{k}_share", real) for k in sorted(rules.grams))]
    return map_runs(df, id_col, text_col, lambda run: measure(run, rules), fields)


def keep_good(df: DataFrame, text_col: str = "text", rules: Rules | None = None) -> DataFrame:
    """The rows of df whose text the rules keep, with all of its columns, in one pass without a shuffle."""
    rules = rules or Rules()
    return keep_runs(df, text_col, lambda run: measure(run, rules)["kept"])
