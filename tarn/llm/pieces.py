"""Byte-pair encoding into sentence pieces through a table of each prefix's last token, and decoding.

For every prefix of a text there is exactly one token that ends its encoding. An automaton over all pieces gives
the pieces that end at each place; the one that may follow the last token of what precedes it (the pair stays two
tokens when its joined string is merged) goes into the table. The ids are then read from the table backwards.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tarn.llm.common import bounded_batches

SPACE = "▁"
#: Words in each of the two caches of one worker.
CACHED_WORDS = 300_000
CACHED_PARTS = 200_000
CACHED_PAIRS = 300_000


class PieceTable:
    """Encodes as a merge-type SentencePiece model with byte fallback and an identity normaliser does."""

    def __init__(self, model: bytes):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.end = sp.eos_id()
        self.piece: dict[int, str] = {}
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(text[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.piece[i], self.score[text], self.ids[text] = text, sp.get_score(i), i
        # If no piece has a space behind another character, words are encoded apart; so are line ends that no piece has.
        self.words_apart = not any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.ids)
        self.joined = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        self.words = re.compile(self._word_pattern())
        self.automaton = ahocorasick.Automaton()
        for text, i in self.ids.items():
            if self._merged(text) == [text]:
                self.automaton.add_word(text, text)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.part_cache: dict[str, list[int]] = {}
        # Words that were met of late are in the one or the other; the older goes when the newer is full.
        self.cache: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.text = [str(i) for i in range(sp.get_piece_size())]

    def _word_pattern(self) -> str:
        """Cuts a text only where no piece reaches over: before spaces, around line ends, and between a letter and a sign that no piece has behind a letter."""
        if not self.words_apart or any("\n" in t for t in self.ids):
            return r"(?s:.+)"
        letter = r"[^\W\d_]"
        behind = {b[1] for b in self.joined if re.match(letter, b[0])}
        signs = "".join(re.escape(chr(c)) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in behind)
        other = rf"(?:(?!{letter})[^{SPACE}\n])"
        return rf"(?=[^\n]){SPACE}*{other}*{letter}*(?:[^{signs}{SPACE}\n][^{SPACE}\n]*)?|\n"

    def _merged(self, text: str) -> list[str]:
        """Repeatedly joins the neighbours whose joined piece has the highest score, of ties the leftmost. For strings of at most two pieces."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._merged(left + right) == [left, right]
        return known

    def last_tokens(self, text: str) -> list[str]:
        """Of each non-empty prefix the last token: a piece, or a single character that no piece is."""
        last = list(text)
        done, pairs, compatible, known = -1, self.pairs, self.compatible, self.ids
        for at, piece in self.automaton.iter(text):
            if at == done:  # the token that ends a prefix is unique
                continue
            start = at + 1 - len(piece)
            if start:
                before = last[start - 1]
                fits = pairs.get((before, piece))
                if fits is None:
                    fits = before not in known or compatible(before, piece)
                if not fits:
                    continue
            last[at] = piece
            done = at
        return last

    def pieces(self, text: str) -> list[str]:
        if len(text) == 1:
            return [text]
        last, out, at = self.last_tokens(text), [], len(text)
        while at > 0:
            token = last[at - 1]
            out.append(token)
            at -= len(token)
        return out[::-1]

    def _ids_of(self, text: str) -> list[int]:
        out = []
        for token in self.pieces(text):
            i = self.ids.get(token)
            out.extend([i] if i is not None else [self.bytes[b] for b in token.encode("utf-8", "surrogatepass")])
        return out

    def _part(self, part: str) -> list[int]:
        if len(self.part_cache) >= CACHED_PARTS:
            self.part_cache.clear()
        known = self._ids_of(part)
        if len(part) <= 64:
            self.part_cache[part] = known
        return known

    def _word(self, word: str) -> str:
        """The ids of a word as text. Encodes the parts between characters that stand side by side in no piece: no token reaches over them."""
        found = self.older.get(word)
        if found is None:
            joined, known, part_ids, ids, at = self.joined, self.part_cache.get, self._part, [], 0
            for i in range(1, len(word)):
                if word[i - 1 : i + 1] not in joined:
                    part = word[at:i]
                    ids += known(part) or part_ids(part)
                    at = i
            part = word[at:]
            ids += known(part) or part_ids(part)
            text = self.text
            found = " ".join([text[i] for i in ids])
        if len(word) <= 64:
            if len(self.cache) >= CACHED_WORDS:
                self.older, self.cache = self.cache, {}
            self.cache[word] = found
        return found

    def encoded(self, text: str) -> str:
        """The decimal ids joined by one space; the end id is the last."""
        if not text:
            return str(self.end)
        text = SPACE + text.replace(" ", SPACE)
        get, own = self.cache.get, self._word
        return " ".join([get(w) or own(w) for w in self.words.findall(text)]) + f" {self.end}"

    def decoded(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


#: One table a model in each worker process.
_TABLES: dict[str, PieceTable] = {}


def piece_table(model: bytes) -> PieceTable:
    key = hashlib.sha256(model).hexdigest()
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = PieceTable(model)
    return _TABLES[key]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


OUTPUTS = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
_SQL = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_decode(docs: DataFrame, model_path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: the key and the asked outputs (n_tokens, ids, decoded, ids_sha256, decoded_sha256).

    Whole texts, null as empty; an empty text has the end id alone. Rows, repeated ones too, stay as they are; other
    columns are not read. The model file (bounded, under a megabyte) travels with the function, so executors need no copy.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    needs_text = "decoded" in outputs or "decoded_sha256" in outputs
    needs_ids = needs_text or "ids" in outputs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model)
        for batch in batches:
            out: dict[str, list] = {name: [] for name in outputs}
            for value in batch.column(1):
                joined = table.encoded(value.as_py() or "")
                ids = list(map(int, joined.split(" "))) if needs_ids else []
                decoded = table.decoded(ids) if needs_text else ""
                for name in outputs:
                    out[name].append(joined.count(" ") + 1 if name == "n_tokens" else ids if name == "ids" else decoded if name == "decoded" else _sha(joined) if name == "ids_sha256" else _sha(decoded))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[n], OUTPUTS[n]) for n in outputs)], ["k", *outputs])

    schema = f"k {kind}, " + ", ".join(f"{n} {_SQL[n]}" for n in outputs)
    return docs.select(docs[f"`{key}`"].alias("k"), docs[f"`{text}`"].alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)
