"""Token counts with a whole-token shortcut, for a SentencePiece BPE model.

BPE only ever builds vocabulary strings, so where no vocabulary string holds two given characters
side by side, no merge crosses that place and the text may be cut there without changing the
result.  From the vocabulary itself :class:`Counter` proves, before any text is read,

* that a meta space (the model's stand-in for a blank) only begins strings, so words are separate,
  and that none holds a line break;
* whether a letter and a non-letter ever stand side by side in one string (else they are cut too);
* which strings, met alone as a pre-token, encode as exactly one token: the *whole tokens*.

A pre-token that is a whole token counts 1 by one look-up.  Only the rest is merged, by the library,
and a bounded memo keeps recent answers.

Defined results: null counts as empty and has 0 tokens; texts of any length are read whole; repeated
rows, and rows with a null ``doc_id``, are counted each; an empty table gives no rows; other columns
are ignored whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import Memo, frugal, table

MODEL, LIMIT, MEMO = "piece_bpe_32k.model", 4096, 250_000
SPACE = "▁"
#: Latin letters; whether strings join them with other characters is checked, not assumed.
LETTERS = "[A-Za-zÀ-ÖØ-öø-ɏ]"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Counts tokens: whole tokens by look-up, the others merged by the library behind a memo."""

    def __init__(self, path: str, memo: int = MEMO):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, proto.ModelProto.SentencePiece
        pieces = [p.piece for p in model.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        inner = any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)
        plain = norm.name == "identity" and not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces
        self.cuttable = plain and not inner and not model.trainer_spec.treat_whitespace_as_suffix and model.trainer_spec.model_type == model.trainer_spec.BPE and not any(p.type == kinds.USER_DEFINED for p in model.pieces)
        letter = re.compile(LETTERS)
        is_letter = lambda c: letter.match(c) is not None
        mixed = any(a != SPACE and is_letter(a) != is_letter(b) for p in pieces for a, b in zip(p, p[1:], strict=False))
        #: Pre-tokens: the meta spaces before a word stay with it; letters and others part if proven.
        self.find = re.compile(f"{SPACE}*{LETTERS}+|{SPACE}*(?:(?!{LETTERS})[^{SPACE}])+|{SPACE}+" if not mixed else f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.S).findall
        self.memo = Memo(self._count, memo, self.whole_tokens(pieces) if self.cuttable else {})

    def whole_tokens(self, pieces: list[str]) -> dict[str, int]:
        """Strings that the library encodes, alone and as pre-tokens, as one token."""
        return {p: 1 for p in pieces if self._count(p) == 1}

    def _count(self, token: str) -> int:
        """Tokens of a pre-token.  The library puts a meta space before what it gets; a pre-token without one follows a line break there, which is one cut-off byte."""
        if token[0] == SPACE:
            return len(self.lib.encode(token[1:])) if len(token) > 1 else self.single_space
        return len(self.lib.encode("\n" + token)) - 2

    @property
    def single_space(self) -> int:
        return len(self.lib.encode("\n" + SPACE)) - 2

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.cuttable:
            return len(self.lib.encode(text))
        return sum(map(self.memo.__getitem__, self.find((SPACE + text).replace(" ", SPACE))))


_counters: dict[tuple[str, int], Counter] = {}


def counter(path: str, memo: int = MEMO) -> Counter:
    if (path, memo) not in _counters:
        _counters[path, memo] = Counter(path, memo)
    return _counters[path, memo]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.  No shuffle: documents are counted where they are read."""
    path = path or model_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [count(x) for x in texts]
            size = [len(x.encode()) if x else 0 for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(frugal(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
