"""Token counts from counts of pieces per distinct pre-token.

A byte-level BPE first cuts a text into pre-tokens and then each pre-token into
pieces, independently of its neighbours. Each distinct pre-token of a task is
encoded once; a document's count is the sum over its pre-token frequencies. No
token ids of a document are ever held. The join is on the map side: a task keeps
the pieces per distinct pre-token in a bounded memo, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import narrow

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Distinct pre-tokens that a task remembers; beyond that it starts anew, which costs time but changes no count.
MEMO = 400_000
#: Characters of text cut into pre-tokens at once.
CHUNK = 1 << 19
#: Characters whose class no version of Unicode or library disputes; where others stand, the library's own pre-tokenizer cuts.
_ODD = re.compile("[^\t-\r -\x7e\xa0-ɏΑ-ΡΣ-ωА-я‐-‧‰-⁞ぁ-んァ-ヶ一-龥가-힣]")
#: Letters in every version of Unicode: a place between one of them, or a visible ASCII character, a space and one of them borders on pre-tokens.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ƺΑ-ΡΣ-ωА-я\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u0905-\u0939\u0e01-\u0e30ぁ-んァ-ヶ一-龥가-힣"


class Counts:
    """Counts tokens as the library's ``encode(text, add_special_tokens=False)`` does, special strings included."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.cut = re.compile(f"(?<=[!-~{_LETTERS}]) (?=[{_LETTERS}])")
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.memo: dict[str, int] = {}

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, text: str) -> Iterator[str]:
        """``text`` cut before words that a space precedes, where pre-tokens begin whatever stands around."""
        at = 0
        while len(text) - at > CHUNK:
            m = self.cut.search(text, at + CHUNK)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def _pre_tokens(self, part: str) -> list[str]:
        if _ODD.search(part):
            return [part[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(part)]
        return self.pattern.findall(part)

    def many(self, texts: list[str]) -> list[int]:
        out, docs = [0] * len(texts), []
        for k, text in enumerate(texts):
            pieces = [text]
            if self.special and (marks := self.special.findall(text)):
                out[k] += len(marks)
                pieces = self.special.split(text)
            freq: Counter[str] = Counter()
            for piece in pieces:
                for part in self._parts(piece):
                    freq.update(self._pre_tokens(part))
            docs.append((k, freq))
        new = list({p for _, freq in docs for p in freq if p not in self.memo})
        if len(self.memo) + len(new) > MEMO:
            self.memo = {}
            new = list({p for _, freq in docs for p in freq})
        for at in range(0, len(new), 20_000):
            self.memo.update(zip(new[at : at + 20_000], self._encode(new[at : at + 20_000]), strict=True))
        memo = self.memo
        for k, freq in docs:
            out[k] += sum([memo[p] * n for p, n in freq.items()])
        return out


def _count(name: str):
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        counts = None
        for b in it:
            counts = counts or Counts(public_tokenizers.path(name))
            texts, done, held, size = b.column(1), [], [], 0
            for t in texts:
                held.append(t.as_py() or "")
                size += len(held[-1])
                if size > CHUNK:
                    done += counts.many(held)
                    held, size = [], 0
            done += counts.many(held)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(done, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return count


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit.

    ``tokenizer`` is a byte-level BPE file known to public_tokenizers. Defined
    cases: a null or empty text has 0 tokens; a special string inside a text is
    one token; ids may be null or repeat; an empty table gives no rows; other
    columns are ignored. Plan: one scan, no shuffle.
    """
    docs = narrow(df, id_col, text_col)
    text = F.coalesce(text_col, F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    t = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    t = t.mapInArrow(_count(tokenizer), f"id {kind}, n_bytes long, n_tokens long")
    return t.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
