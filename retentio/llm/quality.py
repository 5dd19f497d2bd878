r"""Line-first cleaning: rules judge lines, and a document is rejected if too much of it goes.

Every ``\n``-split line that has a word is tested by four rules: punctuation
(more than one symbol in four words, or twenty words without any mark),
navigation (a list of separators, or a menu phrase), boilerplate (licence,
rights, cookie and similar phrases) and repetition (equal to an earlier line).
Failing lines are removed. A document is rejected if it fails the base rules
or if more than half of its words stood in removed lines.

Defined results: a null text has no words and fails, as does an empty one;
lines without words are neither judged nor counted; repeated rows are judged
alike, each for itself; an empty table gives no rows. Other columns are not
read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from retentio.llm.common import batch, pieces, table

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Limits of the rules.
MIN_WORDS, MAX_REPEATED_PCT, MAX_LOST_PCT = 50, 50, 50
WORDS_PER_SYMBOL, MARKLESS_WORDS, MIN_SEPARATORS = 4, 20, 2
MARKS = re.compile(r"[.,;:!?]")
SEPARATOR = re.compile(r" (?:\||>|»|·|•) ")
NAVIGATION = re.compile(r"^ *(?:skip to |back to top|read more|next page|previous page|log ?in\b|sign (?:in|up)\b|share this|print this)", re.I | re.A)
BOILERPLATE = re.compile(
    r"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|we use cookies|licensed under|copyright \(c\)|subscribe (?:to|now)|enable javascript|powered by|click here",
    re.I | re.A,
)


def failing_rule(line: str, n_words: int, n_symbols: int, repeated: bool) -> str | None:
    if n_symbols * WORDS_PER_SYMBOL > n_words or (n_words >= MARKLESS_WORDS and not MARKS.search(line)):
        return "punctuation"
    if len(SEPARATOR.findall(line)) >= MIN_SEPARATORS or NAVIGATION.search(line):
        return "navigation"
    if BOILERPLATE.search(line):
        return "boilerplate"
    return "repetition" if repeated else None


def repeated_words(words: list) -> int:
    """Words covered by 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    size = len(ids)
    pairs = w[:-1] * size + w[1:]
    if size > 1 << 20:  # keep the third word's product inside 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, place, counts = np.unique(pairs[:-1] * size + w[2:], return_inverse=True, return_counts=True)
    hit = counts[place] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def judge(text: str) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text, lost words)."""
    data = text.encode()
    words = data.split()  # bytes split at the same six ASCII characters
    n = len(words)
    chars = len(text) - sum(text.count(chr(c)) for c in SPACES)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen: set[str] = set()
    dup = lost = 0
    kept_lines = []
    for line in text.split("\n"):
        raw = line.encode()
        k = len(raw.split())
        if k:
            again = line in seen
            seen.add(line)
            dup += again
            if failing_rule(line, k, len(raw) - len(raw.translate(None, SYMBOLS)), again):
                lost += k
                continue
        kept_lines.append(line)
    rep = repeated_words(words)
    failed = n < MIN_WORDS or 100 * rep > MAX_REPEATED_PCT * n
    kept = not failed and 100 * lost <= MAX_LOST_PCT * n
    return n, chars, symbols, dup, rep, failed, kept, "\n".join(kept_lines), lost


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned", "n_lost_words")


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and ``FIELDS``; ``cleaned`` is the text without its failing lines."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = f"doc_id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, cleaned string, n_lost_words long"

    def run(batches):
        for part in pieces(batches):
            made = list(zip(*(judge(t or "") for t in part.column("text").to_pylist()), strict=True))
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(made, types, strict=True))], names=["doc_id", *FIELDS])

    return rows.mapInArrow(run, schema)


def op5_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents")).select("doc_id", *FIELDS[:7], "n_lost_words")


QUERIES = {"op5_clean_lines": op5_clean_lines}

SQL = {
    "op5_clean_lines": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (
  SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS a, unnest(list_concat(w[2:], [NULL])) AS b,
         unnest(list_concat(w[3:], [NULL, NULL])[:len(w)]) AS c FROM d WHERE len(w) > 0),
g AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM w WHERE c IS NOT NULL) WHERE n > 1),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
l0 AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS k, len(regexp_extract_all(line, '[#*$%&|<>]')) AS s,
         row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM l0),
j AS (
  SELECT doc_id, k, again,
         s * 4 > k OR (k >= 20 AND NOT regexp_matches(line, '[.,;:!?]'))
         OR len(regexp_extract_all(line, ' (?:\||>|»|·|•) ')) >= 2
         OR regexp_matches(line, '(?i)^ *(?:skip to |back to top|read more|next page|previous page|log ?in\b|sign (?:in|up)\b|share this|print this)')
         OR regexp_matches(line, '(?i)all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|we use cookies|licensed under|copyright \(c\)|subscribe (?:to|now)|enable javascript|powered by|click here')
         OR again AS fails
  FROM l WHERE k > 0),
s AS (
  SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(k) FILTER (fails), 0) AS lost FROM j GROUP BY doc_id),
x AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda t: length(t))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_lost_words
  FROM d LEFT JOIN s USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_lost_words <= 50 * n_words AS kept, n_lost_words
FROM x
"""
}
