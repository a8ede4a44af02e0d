"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Every prefix of a text has one encoding, and that encoding has one last token. The encoder walks over
the text with an automaton of all pieces; of the pieces that end at a position, it stores the one that
is compatible with the last token stored where the piece begins: the two tokens, put side by side,
must merge back into just themselves. The ids then follow backwards from the end of the text.

Nulls count as empty texts; an empty text has only the end id. Texts of any length work: they are cut
where no piece can reach across, so memory follows the longest stretch without such a cut. Repeated
rows give repeated results, an empty table an empty result, and other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import string
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxrill.llm import common
from voxrill.llm.registry import query

SPACE = "▁"
#: Stretches and token pairs that a worker remembers before it begins to forget. Workers live on between
#: tasks and stages, so this is memory that stays: below 200 MB.
CACHE = 300_000
PAIR_CACHE = 300_000
NEVER = float("-inf")


class Coder:
    """Encoder and decoder of one model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        self.end_id = lib.eos_id()
        self.unknown_id = lib.unk_id()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.scores = [lib.get_score(i) for i in range(n)]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if lib.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.text_of = [self._plain(lib, i) for i in range(n)]
        self.decimal = [str(i) for i in range(n)]
        # A mark inserted before the text, and runs of marks, come from the model's settings.
        self.dummy = lib.encode("a", out_type=str)[0].startswith(SPACE)
        self.sizes = [len(p) for p in self.pieces]
        self.start = n  # stands for the start of a text in the pair memory
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.letters = {c for p in self.ids for c in p}
        self.cuts = self._cuts()
        self._stretches: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        self._pairs: dict[int, bool] = {}
        self._forms: dict[int, tuple[list, list, bool]] = {}

    def _cuts(self) -> re.Pattern:
        """Splits a text where no piece can reach across.

        No piece goes on to a mark after another letter; none holds the line breaks or tabs that are
        not among its letters; and none goes on to certain punctuation after anything but such
        punctuation or a mark. All three are read off the vocabulary.
        """
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in self.letters)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return re.compile(rf"[{alone}]|[^{alone}]+" if alone else r"[\s\S]+")
        before: dict[str, set[str]] = {}
        for p in self.ids:
            for a, b in zip(p, p[1:]):
                before.setdefault(b, set()).add(a)
        heads = {c for c in string.punctuation}
        while drop := {c for c in heads if before.get(c, set()) - heads - {SPACE}}:
            heads -= drop
        head = "".join(re.escape(c) for c in sorted(heads))
        rest = rf"[^{SPACE}{alone}{head}]"
        parts = [rf"{SPACE}+[{head}]*{rest}*", rf"[{head}]+{rest}*"] if head else [rf"{SPACE}+{rest}*"]
        return re.compile("|".join([*parts, rf"{rest}+", *([rf"[{alone}]"] if alone else [])]))

    def _plain(self, lib, i: int) -> str:
        if lib.is_control(i):
            return ""
        if lib.is_unknown(i):
            return " ⁇ "
        return self.pieces[i].replace(SPACE, " ")

    def _edges(self, token: int) -> tuple[list, list, bool]:
        """How a token forms out of its letters, by merging: best score first, the leftmost of equals.

        The symbols that stand at its right end in turn, each with the score of the merge that ends
        it; the same for its left end; and whether the merges give the token at all.
        """
        parts = list(self.pieces[token])
        right, left = [], []
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                break
            if at == 0:
                left.append((parts[0], best))
            if at == len(parts) - 2:
                right.append((parts[-1], best))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        right.append((parts[-1], NEVER))
        left.append((parts[0], NEVER))
        return right, left, len(parts) == 1

    def _formed(self, token: int) -> tuple[list, list, bool]:
        found = self._forms.get(token)
        if found is None:
            found = self._forms[token] = self._edges(token)
        return found

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, merge into just themselves.

        That fails if a symbol at the end of the first and one at the start of the second meet and
        make a piece before a merge on their own side takes one of them away.
        """
        ok = self._formed(right)[2] if left == self.start else self._stay_apart(self._formed(left)[0], self._formed(right)[1])
        if len(self._pairs) >= PAIR_CACHE:
            self._pairs.clear()
        self._pairs[left * (self.start + 1) + right] = ok
        return ok

    def _stay_apart(self, ends: list, starts: list) -> bool:
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = ends[i], starts[j]
            across = self.ids.get(x + y)
            if across is not None and self.scores[across] > x_until and self.scores[across] >= y_until:
                return False
            if x_until >= y_until:
                if x_until == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def _known(self, text: str, out: list[int]) -> None:
        """Append the ids of a text of which every letter is a piece."""
        n = len(text)
        whole = self.ids.get(text)
        if whole is not None and self._formed(whole)[2]:
            out.append(whole)
            return
        last, begin = [-1] * (n + 1), [0] * (n + 1)
        last[0] = self.start
        pairs, sizes, radix = self._pairs, self.sizes, self.start + 1
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue  # the last token of a prefix is unique
            at = end - sizes[token]
            before = last[at]
            if before >= 0:
                ok = pairs.get(before * radix + token)
                if ok is None:
                    ok = self._compatible(before, token)
                if ok:
                    last[end], begin[end] = token, at
        found, at = [], n
        while at:
            found.append(last[at])
            at = begin[at]
        out.extend(reversed(found))

    def _stretch(self, text: str) -> tuple[int, ...]:
        out: list[int] = []
        at = 0
        for k, c in enumerate(text):
            if c not in self.letters:
                if at < k:
                    self._known(text[at:k], out)
                at = k + 1
                if self.id_of_byte:
                    out.extend(self.id_of_byte[b] for b in c.encode("utf-8"))
                elif not out or out[-1] != self.unknown_id:
                    out.append(self.unknown_id)
        if at < len(text):
            self._known(text[at:], out)
        ids = tuple(out)
        if len(text) <= 64:
            self._keep(text, ids)
        return ids

    def _keep(self, text: str, ids: tuple[int, ...]) -> None:
        """Remember a stretch. A full memory becomes the old one, of which only what is met again stays."""
        if len(self._stretches) >= CACHE:
            self._older, self._stretches = self._stretches, {}
        self._stretches[text] = ids

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without an end id."""
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if self.dummy:
            text = SPACE + text
        stretches = self.cuts.findall(text)
        parts = list(map(self._stretches.get, stretches))
        if None in parts:
            for k, part in enumerate(parts):
                if part is None:
                    parts[k] = self._lookup(stretches[k])
        return list(chain.from_iterable(parts))

    def _lookup(self, stretch: str) -> tuple[int, ...]:
        found = self._stretches.get(stretch)
        if found is None:
            found = self._older.get(stretch)
            if found is None:
                return self._stretch(stretch)
            self._keep(stretch, found)
        return found

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte tokens joined to characters, bad ones shown as U+FFFD."""
        text_of, byte_of = self.text_of, self.byte_of
        while ids and not text_of[ids[0]] and ids[0] not in byte_of:
            ids = ids[1:]
        if not byte_of or byte_of.keys().isdisjoint(ids):
            text = "".join(map(text_of.__getitem__, ids))
        else:
            out, run = [], bytearray()
            for i in ids:
                b = byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    out.append(_characters(bytes(run)))
                    run.clear()
                out.append(text_of[i])
            if run:
                out.append(_characters(bytes(run)))
            text = "".join(out)
        if self.dummy and ids and ids[0] not in byte_of and ids[0] != self.unknown_id and text.startswith(" "):
            text = text[1:]
        return text


def _characters(run: bytes) -> str:
    """UTF-8 decoding in which every byte outside a whole character becomes U+FFFD."""
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at:at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def coder(model: bytes) -> Coder:
    """The coder of a model; a Python worker keeps it between tasks."""
    return Coder(model)


def _model(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_column(spark: SparkSession, text: Column, model_path: str) -> Column:
    """array<int> of the ids of a text column, the end id included."""
    model = _model(spark, model_path)

    @F.pandas_udf("array<int>")
    def encode(texts):
        c = coder(model.value)
        return texts.map(lambda t: [*c.encode(t or ""), c.end_id])

    return encode(text)


def decode_column(spark: SparkSession, ids: Column, model_path: str) -> Column:
    """The text of an array<int> column; null counts as no ids."""
    model = _model(spark, model_path)

    @F.pandas_udf("string")
    def decode(rows):
        c = coder(model.value)
        return rows.map(lambda r: c.decode([] if r is None else list(map(int, r))))

    return decode(ids)


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens with the end id, and SHA-256 of the ids and of the decoded text; the ids too, if asked.

    Encodes and decodes in one pass over the texts.
    """
    model = _model(docs.sparkSession, model_path)
    id_type = docs.schema[id_col].dataType.simpleString()

    def per_batch(batch: pa.RecordBatch):
        c = coder(model.value)
        # Bounded pieces of a batch, so that the ids of few texts are held at a time.
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            every, first, second = [], [], []
            for raw in part.column(1):
                ids = c.encode(raw.as_py().decode("utf-8", "replace"))
                ids.append(c.end_id)
                first.append(hashlib.sha256(" ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                second.append(hashlib.sha256(c.decode(ids).encode("utf-8")).hexdigest())
                every.append(np.array(ids, np.int32) if with_ids else len(ids))
            columns = {id_col: part.column(0), "n_tokens": pa.array([len(i) for i in every] if with_ids else every, pa.int64())}
            columns |= {"ids_sha256": pa.array(first), "decoded_sha256": pa.array(second)}
            if with_ids:
                columns["ids"] = pa.array(every, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.select(F.col(id_col), common.body(docs, text_col).alias("body")).mapInArrow(
        common.by_batch(per_batch),
        f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""),
    )


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op1_sentencepiece")
def op1_sentencepiece(spark, d):
    """Ids and decoded text of every document, as digests."""
    return digests(common.table(spark, d, "documents"), default_model())
