"""Byte-level BPE as a deterministic automaton over tokens: merges become gadgets, encoding reads words through its tables.

Construction (after Berglund, Martens and van der Merwe, 2024): at first one state loops on the 256 bytes. A merge (u, v) -> w is a
gadget: the state p that u leads to is copied without its arc v, u now leads to the copy, and w is an arc of every state that has an
arc u and leads where v led from p. Paths that read u and then v are gone, those that read w are new, so that after all merges exactly one
path spells any text, and its arcs are the text's tokens. A copy is not written out: it is its arc and step, of which the gadget
table says what was taken away, and an arc is its left part and step. So the tables grow with the number of merges, not with
states times tokens, and `Automaton.has` finds an arc by going back to older copies and to left parts by turns.

Encoding: a text is cut into words by the pattern of the vocabulary's pre-tokenizer. From each state the longest arc that the word
allows is taken; a position that proves dead is never entered again, so a word of any length takes time in proportion to
it. Decoding emits the arcs' labels, bytes, and reads them as UTF-8.

Defined cases: a null or empty text has no tokens and decodes to the empty text. A special token's own string in a text is that
token, as in the tokenizers library. Null ids, repeated rows and further columns change nothing: rows are encoded each by
itself. An id outside the vocabulary decodes to nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from gradloom.llm.words import fresh, once, small

# Fixed value: the pattern of byte-level vocabularies (contractions, then letters, digits, others with a blank before, then blanks).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{LN}]+|\s+(?!\S)|\s+"
# Code points (hexadecimal, both ends) that became letters or digits after Unicode 16, which the vocabulary's library follows.
AFTER_UNICODE_16 = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A
11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 16FF4-16FF6 187F8-187FF 18CD6-18CDA
18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE
1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
""".split()
#: The UTF-8 bytes that a code point from the first of these on may begin with.
HIGH = bytes(range(chr(int(AFTER_UNICODE_16[0], 16)).encode()[0], 256))
#: Words and pairs of tokens that a Python worker remembers, and the longest of these words in characters.
REMEMBERED, REMEMBERED_PAIRS, REMEMBERED_LENGTH = 400_000, 200_000, 48
#: Words of one text that are held at a time.
HELD_WORDS = 65_536


def _patterns() -> tuple[regex.Pattern, regex.Pattern]:
    """For texts whose code points are all below the first of these, and for all texts."""
    newer = "".join("-".join(f"\\U{int(c, 16):08X}" for c in r.split("-")) for r in AFTER_UNICODE_16)
    letters, digits = f"[\\p{{L}}--[{newer}]]", f"[\\p{{N}}--[{newer}]]"
    both = f"[[\\p{{L}}\\p{{N}}]--[{newer}]]"
    plain = PATTERN.replace("{LN}", r"\p{L}\p{N}").replace("{L}", r"\p{L}").replace("{N}", r"\p{N}")
    return regex.compile(plain), regex.compile(PATTERN.replace("{LN}", both).replace("{L}", letters).replace("{N}", digits), regex.V1)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: itself if it can be printed, else the next letter from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass(frozen=True)
class Vocabulary:
    """Token ids by their bytes, merges in order (both parts as bytes), and strings that are tokens wherever they stand."""

    ids: dict[bytes, int]
    merges: list[tuple[bytes, bytes]]
    special: dict[str, int]

    def labels(self) -> dict[int, bytes]:
        return {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}


def default_path() -> str:
    """The byte-level vocabulary among the installed public tokenizers."""
    return public_tokenizers.path("byte_bpe_50k.json")


def read_vocabulary(path: str) -> Vocabulary:
    """A byte-level vocabulary file of the tokenizers library; settings that this module does not follow are an error."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, split, decoder = whole["model"], whole["pre_tokenizer"] or {}, whole["decoder"] or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    added = whole["added_tokens"]
    known = (model["type"] == "BPE" and plain and whole["normalizer"] is None and split.get("type") == decoder.get("type") == "ByteLevel"
             and not split.get("add_prefix_space") and split.get("use_regex", True) and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")))
    if not known:
        raise ValueError(f"{path} is no plain byte-level vocabulary")
    letters = byte_letters()
    of = lambda token: bytes(letters[c] for c in token)
    special = {t["content"]: t["id"] for t in added}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return Vocabulary({of(t): i for t, i in model["vocab"].items() if t not in special}, [(of(a), of(b)) for a, b in merges], special)


class Automaton:
    """Arcs are numbered: the bytes first, then one for each merge that some text can need.

    By arc: `left` and `right` part, the step that `made` it (0 for bytes), its `label`. A state is the target of an arc u after the gadgets
    of some step; `gadget` has the step at which the target of u was copied without its arc v.
    """

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.label = [bytes([b]) for b in range(256)]
        self.arcs = {label: arc for arc, label in enumerate(self.label)}
        self.left, self.right, self.made = [*range(256)], [*range(256)], [0] * 256
        self.gadget: dict[int, int] = {}  # u << 32 | v
        for step, parts in enumerate(merges, 1):
            u, v = map(self.arcs.get, parts)
            if u is None or v is None or not self.has(u, v, step):
                continue  # no path reads u and then v
            label = b"".join(parts)
            if label in self.arcs:
                raise ValueError(f"two merges make {label!r}")
            self.arcs[label] = len(self.label)
            self.label.append(label)
            self.left.append(u)
            self.right.append(v)
            self.made.append(step)
            self.gadget[u << 32 | v] = step
        self.end = len(merges)
        #: Whether one arc may follow another, of pairs that were asked for.
        self.pairs: dict[int, bool] = {}
        #: The longest label by its first four bytes (a shorter label is found by none).
        self.reach: dict[bytes, int] = {}
        for label in self.label:
            self.reach[label[:4]] = max(self.reach.get(label[:4], 0), len(label))

    def has(self, u: int, v: int, step: int) -> bool:
        """Whether the target of arc u after the gadgets of `step` has an arc v."""
        made, gadget = self.made, self.gadget
        while True:
            gone = gadget.get(u << 32 | v)
            if gone is not None and gone <= step:
                return False
            if made[u] > made[v]:
                # Older than the target of u, which began as that of the right part at the time.
                step = made[u] - 1
                u = self.right[u]
            elif made[v]:
                # Made when this state was there: it has v if it had the left part.
                step = made[v]
                v = self.left[v]
            else:
                return True  # the first state loops on every byte

    def read(self, word: bytes) -> list[int]:
        """The arcs of the one path that spells the word, the longest tried first.

        A prefix has one path too, so a position has one state: a position that is dead once is never entered again.
        """
        arcs, reach, pairs, end = self.arcs, self.reach, self.pairs, self.end
        path: list[int] = []
        sizes: list[int] = []
        dead: set[int] = set()
        at, n, last = 0, len(word), -1
        size = min(reach.get(word[:4], 3), n)
        while at < n:
            while size:
                arc = arcs.get(word[at:at + size])
                if arc is not None and at + size not in dead:
                    if last < 0:
                        break
                    pair = last << 32 | arc
                    found = pairs.get(pair)
                    if found is None:
                        if len(pairs) > REMEMBERED_PAIRS:
                            pairs.clear()
                        found = pairs[pair] = self.has(last, arc, end)
                    if found:
                        break
                size -= 1
            if size:
                path.append(arc)
                sizes.append(size)
                last = arc
                at += size
                size = min(reach.get(word[at:at + 4], 3), n - at)
            else:
                dead.add(at)
                path.pop()
                last = path[-1] if path else -1
                size = sizes.pop()
                at -= size
                size -= 1
        return path


class Known(dict):
    """Packed ids by word. A new word is read by the automaton and remembered, up to a fixed number of words."""

    def __init__(self, automaton: Automaton, packed: list[bytes]):
        self.automaton, self.packed = automaton, packed

    def __missing__(self, word: str) -> bytes:
        ids = b"".join([self.packed[arc] for arc in self.automaton.read(word.encode())])
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Texts to token ids with one compiled automaton; remembers the tokens of words it has seen, up to a fixed number."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = Automaton(vocabulary.merges)
        lost = [label for label in self.automaton.label if label not in vocabulary.ids]
        if lost:
            raise ValueError(f"the vocabulary has no ids for {lost[:3]}")
        self.known = Known(self.automaton, [vocabulary.ids[label].to_bytes(4, "little") for label in self.automaton.label])
        self.special = {s: i.to_bytes(4, "little") for s, i in vocabulary.special.items()}
        longest_first = sorted(vocabulary.special, key=len, reverse=True)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.plain, self.any = _patterns()

    def _piece(self, text: str) -> Iterator[bytes]:
        """Ids of a text without special tokens, for at most HELD_WORDS words at a time."""
        data = text.encode()
        pattern = self.plain if len(data.translate(None, HIGH)) == len(data) else self.any
        if len(text) <= HELD_WORDS:
            yield b"".join(map(self.known.__getitem__, pattern.findall(text)))
            return
        matches = pattern.finditer(text)
        while words := [m[0] for m in islice(matches, HELD_WORDS)]:
            yield b"".join(map(self.known.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        parts: list[bytes] = []
        for piece in self.at_special.splititer(text) if self.at_special and self.at_special.search(text) else (text,):
            if piece in self.special:
                parts.append(self.special[piece])
            elif piece:
                parts.extend(self._piece(piece))
        return b"".join(parts)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", tokens: str = "tokens") -> DataFrame:
    """All rows and columns, and `tokens`: the ids of the whole text, packed as little-endian unsigned 32-bit integers (see `token_ids`).

    The vocabulary is broadcast: its size is that of its file. Each Python worker compiles it once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    key = uuid.uuid4().hex
    columns, made = docs.columns, fresh(docs, tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(key, lambda: Encoder(sent.value))
        for batch in small(batches):
            ids = [encoder.encode(t.as_py() or "") for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(ids, pa.binary())], names=[*columns, made])

    return docs.mapInArrow(run, _with(docs, made, "binary"))


def decode(encoded: DataFrame, vocabulary: Vocabulary, tokens: str = "tokens", decoded: str = "decoded") -> DataFrame:
    """All rows and columns, and `decoded`: the text of the packed ids; bytes that are no UTF-8 become U+FFFD, null ids the empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary.labels())
    columns, made = encoded.columns, fresh(encoded, decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = sent.value
        for batch in small(batches):
            texts = []
            for ids in batch.column(tokens):
                ids = np.frombuffer(ids.as_py() or b"", "<u4").tolist()
                texts.append(b"".join([labels.get(i, b"") for i in ids]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string())], names=[*columns, made])

    return encoded.mapInArrow(run, _with(encoded, made, "string"))


def _with(df: DataFrame, name: str, kind: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` {kind}"])


def token_ids(tokens) -> object:
    """Packed ids as `array<long>`, a column expression."""
    digit = lambda i, k: F.conv(F.hex(F.substring(tokens, i * 4 + k + 1, F.lit(1))), 16, 10).cast("long") * (1 << 8 * k)
    n = F.floor(F.length(tokens) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: digit(i, 0) + digit(i, 1) + digit(i, 2) + digit(i, 3))).otherwise(F.array().cast("array<bigint>"))


def round_trip(docs: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, and decoded again from the ids."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    encoded = encode(rows, vocabulary).select("doc_id", "tokens")
    return decode(encoded, vocabulary).select("doc_id", F.floor(F.length("tokens") / 4).cast("long").alias("n_tokens"), F.sha2("tokens", 256).alias("ids_sha256"),
                                              F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
