r"""Secret scans: fixed patterns, and strings that a primed compressor cannot predict.

Base spans are three patterns: assignments, access keys and long hexadecimal
runs. The method then looks at every other long unbroken string within
``CONTEXT`` characters of a sensitive word, on either side: it is compressed by
zstandard primed with a dictionary of the text around it, the sensitive words
and common identifiers, and its marginal bytes (over an empty input) are
measured. Words, paths, repeated names and placeholders are cheap under such a
dictionary; random material is not. A string that costs at least ``MIN_COST``
bytes a character is reported as ``novel``. From such a string the search goes
on, however far, over adjoining lines that hold one such string and nothing
else; a line break may be written as ``\n``. The shorter last line of a block is
measured with the line before it.

Offsets are code points, ends exclusive. Defined results: a null or empty text
has no spans; repeated rows are scanned alike, each for itself; an empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from retentio.llm.common import pieces, table

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
#: Words that make what is near them sensitive, a part of each of them, and the strings looked at.
SENSITIVE = re.compile(r"pass[\s_-]?(?:word|wd|phrase)|pwd(?![a-z0-9])|secret|token|(?:api|private|access|encryption|signing)[\s_-]*key|credential|authorization|bearer|signature", re.I | re.A)
SENSITIVE_PARTS = ("pass", "pwd", "secret", "token", "key", "credential", "authorization", "bearer", "signature")
CANDIDATE, TAIL = re.compile(r"[A-Za-z0-9+/_=-]{16,}"), re.compile(r"[A-Za-z0-9+/_=-]*")
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LINE_END, ESCAPED = re.compile(r"\r\n?|\n|(?:\\r)?\\n"), re.compile(r"\\[nrt]")
#: A line of a block: one string, and beside it only what is no letter or digit.
BLOCK_LINE = re.compile(r"[^A-Za-z0-9+/_=-]*+([A-Za-z0-9+/_=-]++)[^A-Za-z0-9]*+")
BLOCK_END = re.compile(r"(?:\\[nr]|[^A-Za-z0-9-])*+---")
#: Reach of a sensitive word and context of a string on each side, and marginal bytes a character from which a string counts as random.
CONTEXT, MIN_COST = 400, 0.78
IDENTIFIERS = (
    "password passwd secret token api_key apikey credential private_key access_key authorization bearer signature "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 config settings environment variable default example "
    "placeholder your_token_here changeme localhost connection database username user_name client_id client_secret "
    "function return import class public static void string object value request response header content_type application json"
).encode()

#: Ordinary text and names, for character statistics.
SAMPLE = (
    "a plain sentence with common words gives the usual share of each letter, while names like readConfigFile, "
    "max_retry_count, /usr/local/share/doc, getElementById, is_enabled and HTTPServer add what code has beside it; "
    "numbers such as 1024, 3.14, 2017-06-30 and 8080 are rare, and so are capital letters in running text"
)


def novelty(candidate: str, before: str, after: str) -> float:
    """Marginal compressed bytes a character of ``candidate`` among the text around it, primed with common identifiers.

    The text around it (and a fixed sample, where there is little) also gives
    the character statistics, so ordinary words cost little even when new.
    """
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    around = (SAMPLE + " " + before + " " + after + " ").encode()
    return (len(press.compress(around + candidate.encode())) - len(press.compress(around))) / len(candidate)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, leftmost and non-overlapping for each."""
    found = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def near_words(text: str) -> list[tuple[int, int]]:
    """Spans of the candidates within ``CONTEXT`` of a sensitive word; such words are no part of them."""
    words = [m.span() for m in SENSITIVE.finditer(text)]
    out = []
    for k in range(len(words) + 1 if words else 0):
        # the gap between two words, as far as either reaches; whole strings at the ends of the reach
        left, right = words[k - 1][1] if k else 0, words[k][0] if k < len(words) else len(text)
        reached = [(left, right)]
        after, before = min(right, left + CONTEXT) if k else left, max(left, right - CONTEXT) if k < len(words) else right
        if after < before:
            before = left + len(text[left:before].rstrip(CHARACTERS))
            reached = [(left, min(right, TAIL.match(text, after).end())), (before, right)] if k else [(before, right)]
            if k == len(words):
                reached = reached[:1]
            if len(reached) == 2 and reached[0][1] >= reached[1][0]:
                reached = [(left, right)]
        for lo, hi in reached:
            for m in CANDIDATE.finditer(text, lo, hi):
                start, end = m.span()
                start += start > 0 and ESCAPED.match(text, start - 1) is not None
                if end - start >= 16:
                    out.append((start, end))
    return out


def block_around(text: str, lines: list[tuple[int, int]], start: int, end: int) -> tuple[list[tuple[int, int]], tuple[int, int] | None]:
    """Strings of the adjoining block lines around one, in order, and a shorter one behind them."""
    own = bisect_right(lines, (start, len(text))) - 1
    m = BLOCK_LINE.fullmatch(text, *lines[own])
    if not m or m.span(1) != (start, end):
        return [(start, end)], None
    sides, rest = ([], []), None
    for side, step in zip(sides, (-1, 1), strict=True):
        at = own + step
        while 0 <= at < len(lines) and (m := BLOCK_LINE.fullmatch(text, *lines[at])):
            if m.end(1) - m.start(1) < 16:
                rest = m.span(1) if step > 0 else None
                break
            side.append(m.span(1))
            at += step
    return sides[0][::-1] + [(start, end)] + sides[1], rest


def novel_spans(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Unpredictable strings near sensitive words, and in the lines that adjoin them, beside the known spans."""
    low = text.lower()
    if not any(w in low for w in SENSITIVE_PARTS):
        return []
    # starts rise, so the latest end so far tells whether a span reaches behind a place
    starts, reach = [a for a, _, _ in known], list(accumulate((b for _, _, b in known), max))
    out, tested, lines = [], set(), None
    for near in near_words(text):
        if near[0] in tested:
            continue
        if lines is None:
            breaks = [m.span() for m in LINE_END.finditer(text)]
            lines = list(zip([0, *(b for _, b in breaks)], [*(a for a, _ in breaks), len(text)], strict=True))
        block, rest = block_around(text, lines, *near)
        # the lines of a block do not make each other cheap
        before, after = text[max(0, block[0][0] - CONTEXT) : block[0][0]], text[block[-1][1] : block[-1][1] + CONTEXT]
        found = False
        for start, end in block:
            if start in tested:
                continue
            tested.add(start)
            k = bisect_left(starts, end)
            found = not (k and reach[k - 1] > start) and novelty(text[start:end], before, after) >= MIN_COST
            if found:
                out.append((start, 3, end))
        if rest and found:
            # a short line ends a block if padding, an end mark or two equal lines show one
            (a, b), (start, end) = rest, block[-1]
            padded, marked = text[b - 1] == "=", BLOCK_END.match(text, b)
            if (padded or marked or (len(block) > 1 and end - start == block[-2][1] - block[-2][0])) and novelty(text[start:end] + text[a:b], before, text[b : b + CONTEXT]) >= MIN_COST:
                out.append((a, 3, b))
    return sorted(out)


def scan(text: str) -> tuple[list, list]:
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base))


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel and the matched strings."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long, secrets array<string>"

    def run(batches):
        for part in pieces(batches):
            out = []
            for text in part.column("text").to_pylist():
                base, spans = scan(text or "")
                counts = [sum(k == n for _, k, _ in base) for n in range(3)]
                out.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans) - len(base), [text[a:b] for a, _, b in spans]))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.list_(pa.string())]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel", "secrets"]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names=names)

    return rows.mapInArrow(run, schema)


def op7_find_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents")).drop("secrets")


QUERIES = {"op7_find_secrets": op7_find_secrets}
SQL: dict[str, str] = {}
