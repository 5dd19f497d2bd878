"""Token-ID / binary output: length-delimited binary records with an offset index.

Every text is encoded by a ``tokenizers`` vocabulary, closed by an end id and
stored as one framed record: length (8 bytes), masked checksum of the length
(4), payload, masked checksum of the payload (4), all little-endian. A file
starts with a 16-byte header; beside each ``.bin`` an ``.idx`` file lists the
byte offset of every record, so a shuffled reader can seek to any of them.
Files hold consecutive ranges of document ids; ranges depend on the rows only,
so a rerun writes the same bytes. A file is written under a temporary name and
renamed; the manifest, written last, lists the files with their totals.

Defined results: a null text is encoded as an empty one (only the end id); a
null doc_id comes first; equal doc_ids are separate records, ordered by their
ids; an empty table gives an empty manifest and no rows. Other columns are not
read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import filterfalse, islice
from string import ascii_letters
from string import punctuation as PUNCTUATION

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm.common import batch, commit_file, filesystem, id_cuts, kept, output_root, pieces, shard_of, table

MAGIC = b"RETTOK01"
HEADER = 16
#: How much text one output file covers.
SHARD_TEXT_BYTES = 16 << 20
END_ID = 2
#: Bounds of a worker's cache: words, the longest word kept, and what a trim leaves.
CACHE_WORDS, CACHE_CHARS, CACHE_KEPT = 300_000, 40, 150_000
#: Bytes of the texts whose words are numbered together.
TOGETHER_BYTES = 2 << 20
#: Words of these letters share ids whatever of this punctuation is behind them.
LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]"
LATIN = [c for c in map(chr, range(0xC0, 0x100)) if c.isalpha()]
SHARED = frozenset(ascii_letters).union(LATIN)


#: Fixed value: the offset of masked checksums in the length-delimited record format.
MASK_OFFSET = 0xA282EAD8


def masked(data: bytes) -> int:
    """CRC-32, rotated and offset, so that a checksum of stored checksums stays telling."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_OFFSET) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(stream) -> Iterator[bytes]:
    """Payloads of a stream of frames; a damaged or cut frame is an error."""
    while head := stream.read(12):
        size, check = struct.unpack("<QI", head)
        if masked(head[:8]) != check:
            raise ValueError("damaged record length")
        payload = stream.read(size)
        if len(payload) != size or struct.unpack("<I", stream.read(4))[0] != masked(payload):
            raise ValueError("damaged record")
        yield payload


def _large(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Texts to little-endian ids, equal to the library's encoding of the whole text.

    The byte-level pre-tokenizer never joins characters across a single space
    between two other characters, nor across a single line end, so texts
    are cut there, Arrow numbers the distinct words of some texts, and each is
    encoded by the library once (as long as the cache holds it), all new ones in
    one call. It also parts letters from the punctuation behind them: such
    words share the ids of their letters, which go to the library's model
    without its pre-tokenizer. A text with any other white space, or with a
    special token's string, is encoded whole; only new words are looked at for
    that, as no known word has any.
    """

    def __init__(self, path: str):
        os.environ.update(TOKENIZERS_PARALLELISM="false", RAYON_NUM_THREADS="1")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        split = json.loads(self.library.pre_tokenizer.__getstate__()) if self.library.pre_tokenizer else {}
        self.dtype = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.line = line[0]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not self.library.normalizer
        # no special token may lie across words, or letters and punctuation
        spread = re.compile(rf".*\s.*|{LETTERS}*[{re.escape(PUNCTUATION)}]*", re.DOTALL)
        self.cuts = bool(plain) and len(line) == 1 and not any(map(spread.fullmatch, self.special))
        # what the byte-level pre-tokenizer shows of a character to the model
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = str.maketrans({c: shown.pre_tokenize_str(c)[0][0] for c in [" ", "\n", *LATIN]})
        self.letters = Tokenizer(self.library.model)
        self.letters.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\t")
        self.known: dict[str, bytes] = {}

    def _encode(self, text: str, library=None) -> np.ndarray:
        return np.array((library or self.library).encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _parted(self, ids: np.ndarray, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words with their ids, where each stands behind a line end; a word that begins with one keeps it."""
        at = np.flatnonzero(ids == self.line)
        if len(at) != len(words):
            raise ValueError("the vocabulary joins line ends to words")
        data, size = ids.tobytes(), ids.itemsize
        starts = at * size + np.array([0 if w[0] == "\n" else size for w in words])
        return zip(words, [data[i:j] for i, j in zip(starts.tolist(), [*(at[1:] * size).tolist(), len(data)], strict=True)], strict=True)

    def _encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words as they follow a space, or with the line end before them, encoded in one call: a line end cannot join what stands beside it."""
        if not words:
            return iter(())
        return self._parted(self._encode("".join(["\n" + w[1:] if w[0] == "\n" else "\n " + w for w in words])), words)

    def _encode_letters(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """The same for words of letters alone, which the pre-tokenizer leaves whole: the model gets them one by one."""
        if not words:
            return iter(())
        line, space = (self.shown[ord(c)] for c in "\n ")
        between = f"\t{line}\t{space}"
        text = between.join([w if w.isascii() else w.translate(self.shown) for w in words])
        return self._parted(self._encode(f"{between[1:]}{text}", self.letters), words)

    def _learn(self, new: list[str], letters: list[str]) -> None:
        """New words, and words of letters alone, into the cache."""
        self.known.update(self._encode_words(new))
        self.known.update(self._encode_letters(letters))

    def _odd(self, words: list[str]) -> set[str]:
        """Words that hold white space but a line end before other characters (no other is printable), or a special token."""
        text = "".join(words)
        if all(words) and "\n" not in words and text.replace("\n", "").isprintable() and not any(s in text for s in self.special):
            return set()
        return {w for w in words if w in ("", "\n") or not w[w[0] == "\n" :].isprintable() or any(s in w for s in self.special)}

    def _ids(self, texts: pa.Array) -> Iterator[bytes]:
        # a line end between two words stands in front of the second one, in place of the space; so does one put before the text
        lines = pc.binary_join_element_wise(_large("\n"), pc.replace_substring(texts, "\n", " \n"), _large(""))
        cut = pc.split_pattern(lines, " ")
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary
        # letters and the punctuation behind them; what is not kept stays in one
        stems = pc.ascii_rtrim(words, PUNCTUATION)
        alone = pc.and_(pc.match_substring_regex(stems, f"^{LETTERS}+$"), pc.less_equal(pc.binary_length(words), CACHE_CHARS))
        units = pc.if_else(alone, stems, words).dictionary_encode()
        tails = pc.if_else(alone, pc.replace_substring_regex(words, f"^{LETTERS}+", ""), _large("")).dictionary_encode()
        known, names = self.known, _strings(units.dictionary)
        new = list(filterfalse(known.__contains__, names))
        odd = self._odd(new) if new else set()
        letters = {s for s in new if s.isalpha() and len(s) <= CACHE_CHARS and (s.isascii() or set(s) <= SHARED)}
        self._learn([w for w in new if w not in letters and w not in odd], list(letters))
        of_unit = pa.array([known.get(u, b"") for u in names] if odd else list(map(known.__getitem__, names)), pa.large_binary())
        of_tail = pa.array([self._encode(t).tobytes() if t else b"" for t in _strings(tails.dictionary)], pa.large_binary())
        ids = pc.binary_join_element_wise(of_unit.take(units.indices), of_tail.take(tails.indices), pa.scalar(b"", pa.large_binary())).take(coded.indices)
        borders, whole = cut.offsets.to_numpy(), np.zeros(len(texts), bool)
        if odd:
            of_word = np.array([u in odd for u in names])[units.indices.to_numpy()][coded.indices.to_numpy()]
            whole = np.add.reduceat(of_word, borders[:-1], dtype=np.int64) > 0
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, ids.offset * 8)[borders].tolist()
        data, size = memoryview(ids.buffers()[2] or b""), np.dtype(self.dtype).itemsize
        for i, odd_text in enumerate(whole.tolist()):
            yield self._encode(texts[i].as_py()).tobytes() if odd_text else bytes(data[ends[i] + size : ends[i + 1]])
        for w in new:
            if len(w) > CACHE_CHARS:
                known.pop(w, None)
        if len(known) > CACHE_WORDS:
            self.trim()

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each of some texts (none of them null)."""
        texts = texts.cast(pa.large_string())
        if not self.cuts:
            yield from (self._encode(t).tobytes() for t in texts.to_pylist())
            return
        sizes, start, size = pc.binary_length(texts).to_pylist(), 0, 0
        for i, n in enumerate(sizes, 1):
            size += n
            if size > TOGETHER_BYTES or i == len(sizes):
                yield from self._ids(texts.slice(start, i - start))
                start, size = i, 0

    def ids(self, text: str) -> bytes:
        return next(self.encode(pa.array([text], pa.large_string())))

    def trim(self) -> None:
        """Keep what was met first, the common words; also between tasks, as the worker goes on to other work."""
        if len(self.known) > CACHE_KEPT:
            self.known = dict(islice(self.known.items(), CACHE_KEPT))


def encoder(path: str) -> Encoder:
    """One encoder per worker process; it outlives a task, and so does its cache."""
    return kept(path, lambda: Encoder(path))


def _write_file(fs, folder: str, name: str, width: int, records) -> tuple:
    """Write one shard and its index; returns its manifest entry."""
    n = tokens = total = crc = 0
    offsets = []
    paths = {k: f"{folder}/_tmp-{uuid.uuid4().hex}.{k}" for k in ("bin", "idx")}
    with fs.open_output_stream(paths["bin"]) as out:
        out.write(MAGIC + struct.pack("<II", width, 0))
        total = HEADER
        for doc_id, ids in records:
            payload = struct.pack("<?q", doc_id is not None, doc_id or 0) + ids
            data = frame(payload)
            out.write(data)
            offsets.append(total)
            total += len(data)
            crc = zlib.crc32(data, crc)
            n += 1
            tokens += len(ids) // width
    with fs.open_output_stream(paths["idx"]) as out:
        out.write(np.array(offsets, "<u8").tobytes())
    for k, path in paths.items():
        commit_file(fs, path, f"{folder}/{name}.{k}")
    return name, n, tokens, total, crc


def write_tokens(docs: DataFrame, root: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_TEXT_BYTES) -> list[dict]:
    """Encode and write ``docs`` below ``root``; returns the manifest's files in id order."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = np.array(id_cuts(docs, "doc_id", F.octet_length("text") + 64, shard_bytes), np.int64)
    made = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def encode(batches):
        enc = encoder(vocabulary)
        end = np.array([end_id], enc.dtype).tobytes()
        for part in pieces(batches, 1024):
            ids = [i + end for i in enc.encode(part.column("text"))]
            yield batch(made, [shard_of(part.column("doc_id"), cuts), part.column("doc_id"), ids])
        enc.trim()
        pa.default_memory_pool().release_unused()

    listed = pa.schema([("name", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64()), ("crc32", pa.int64()), ("width", pa.int32())])

    def write(batches):
        width = np.dtype(encoder(vocabulary).dtype).itemsize
        fs, folder = filesystem(root)
        rows = ((s, d, i) for part in pieces(batches) for s, d, i in zip(*(part.column(c).to_pylist() for c in ("shard", "doc_id", "ids")), strict=True))
        from itertools import groupby

        for shard, group in groupby(rows, key=lambda r: r[0]):
            entry = _write_file(fs, folder, f"tokens-{shard:06d}", width, ((d, i) for _, d, i in group))
            yield batch(listed, [[x] for x in (*entry, width)])

    fs, folder = filesystem(root)
    fs.create_dir(folder, recursive=True)
    parts = docs.mapInArrow(encode, "shard int, doc_id long, ids binary").repartition(len(cuts) + 1, "shard").sortWithinPartitions("shard", "doc_id", "ids")
    files = sorted((r.asDict() for r in parts.mapInArrow(write, "name string, records long, tokens long, bytes long, crc32 long, width int").collect()), key=lambda r: r["name"])
    start = 0
    for f in files:
        f["start"], start = start, start + f["tokens"]
    temporary = f"{folder}/_tmp-manifest-{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        out.write(json.dumps({"format": MAGIC.decode(), "end_id": end_id, "vocabulary": os.path.basename(vocabulary), "files": files}).encode())
    commit_file(fs, temporary, f"{folder}/manifest.json")
    return files


def read_manifest(root: str) -> list[dict]:
    fs, folder = filesystem(root)
    with fs.open_input_stream(f"{folder}/manifest.json") as f:
        return json.loads(f.read())["files"]


def read_tokens(spark: SparkSession, root: str, with_ids: bool = True) -> DataFrame:
    """Records of all files of the manifest: file, record, doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids."""
    files = read_manifest(root)
    schema = "file string, record long, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if not files:
        return spark.createDataFrame([], schema)
    fields = [("file", pa.string()), ("record", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    made = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def read(batches):
        fs, folder = filesystem(root)
        for part in batches:
            for name, start, width, n in zip(*(part.column(c).to_pylist() for c in ("name", "start", "width", "records")), strict=True):
                with fs.open_input_stream(f"{folder}/{name}.bin", buffer_size=1 << 20) as stream:
                    if stream.read(HEADER)[: len(MAGIC)] != MAGIC:
                        raise ValueError(f"{name}: not a token file")
                    rows, seen = [], 0
                    for k, payload in enumerate(unframe(stream)):
                        has, doc_id = struct.unpack_from("<?q", payload)
                        ids = np.frombuffer(payload, f"<u{width}", offset=9).astype("<u4")
                        rows.append((name, k, doc_id if has else None, start, len(ids), zlib.crc32(ids.tobytes())) + (ids.astype(np.int32),) * with_ids)
                        start += len(ids)
                        seen += 1
                        if len(rows) == 256:
                            yield batch(made, list(zip(*rows, strict=True)))
                            rows = []
                    if seen != n:
                        raise ValueError(f"{name}: {seen} of {n} records")
                    if rows:
                        yield batch(made, list(zip(*rows, strict=True)))

    listed = spark.createDataFrame([(f["name"], f["start"], f["width"], f["records"]) for f in files], "name string, start long, width int, records long")
    return listed.repartition(len(files)).mapInArrow(read, schema)


def read_record(root: str, name: str, record: int) -> tuple[int | None, np.ndarray]:
    """One record by its place, through the offset index (shuffled reads)."""
    width = next(f["width"] for f in read_manifest(root) if f["name"] == name)
    fs, folder = filesystem(root)
    with fs.open_input_file(f"{folder}/{name}.idx") as index:
        index.seek(8 * record)
        at = struct.unpack("<Q", index.read(8))[0]
    with fs.open_input_file(f"{folder}/{name}.bin") as data:
        data.seek(at)
        payload = next(unframe(data))
    has, doc_id = struct.unpack_from("<?q", payload)
    return doc_id if has else None, np.frombuffer(payload, f"<u{width}", offset=9)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_records(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write ``docs`` as token files below the checkpoint folder and read the digest columns back."""
    spark = docs.sparkSession
    root = output_root(spark, "tokens")
    write_tokens(docs, root, vocabulary or vocabulary_path())
    return read_tokens(spark, root, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents"))


QUERIES = {"op9_token_records": op9_token_records}
SQL: dict[str, str] = {}
