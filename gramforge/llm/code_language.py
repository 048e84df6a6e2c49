"""Natural language inside source code, told apart by compression.

Comments and string literals are cut out by the lexers of `code_lexer`. The words of each span are compressed
with one zstandard dictionary per language, made of labelled prose (`language_seed`, plus word lists given by the
caller, or a `LanguageModel` of one's own); the language of the shortest encoding wins. A span is rejected
if it holds fewer than `min_words` plain words, or if a dictionary of program code encodes it as short as the
best language does (margin test). Languages within one byte of each other count as tied; the one whose
dictionary text knows more of the span's words wins.

The dictionaries are fixed before any file is read: nothing is fitted on the rows that are classified.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramforge.llm.code_lexer import plain, units
from gramforge.llm.language_seed import CODE_SEED, SEED
from gramforge.util import col, reject_clash, require

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\Z")
_OPTION = re.compile(r"--+[a-z]")
_OUTER = "\"'`.,;:!?…()[]{}<>«»“”¿¡*-"
#: A token in one of these is a name or a quotation from code, not running text.
_QUOTED_CODE = re.compile(r"`[^`]*`|\[[^\]\s]*\]|https?://\S+")


def bare(text: str) -> str:
    """Without accents (canonical decomposition without combining marks)."""
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def plain_words(text: str) -> list[str]:
    """Tokens that are words: letters only once outer punctuation is removed."""
    if "`" in text or "[" in text or "://" in text:
        text = _QUOTED_CODE.sub(" ", text)
    out = []
    for raw in text.split():
        if raw.isalpha():
            out.append(raw.lower())
            continue
        t = raw.strip(_OUTER)
        if not t or not _WORD.match(t):
            continue
        # An option of a command, a call or a path is no word.
        if raw[0] == "-" and (raw[1:2].isalpha() or _OPTION.match(raw)) or raw[-1] == "(" or "()" in raw or "::" in raw:
            continue
        out.append(t.lower())
    return out


@dataclass(frozen=True)
class LanguageModel:
    """The labelled texts the dictionaries are made of."""

    texts: Mapping[str, bytes]
    code: bytes


class Identifier:
    """Compressors of one model. level (of zstandard), code_margin and near (bytes) are parameters of the method; a task remembers `kept` texts of up to 1000 characters."""

    def __init__(self, model: LanguageModel, level: int = 9, code_margin: int = 1, near: int = 1, kept: int = 1 << 16):
        def packer(raw: bytes) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(raw), write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=p)
            return zstandard.ZstdCompressor(dict_data=d, compression_params=p)

        self.packers = {k: packer(v) for k, v in model.texts.items()}
        self.code = packer(model.code)
        self.vocabulary = {k: frozenset(re.findall(r"[^\W\d_]+", v.decode("utf-8", "ignore"))) for k, v in model.texts.items()}
        self.code_margin, self.near = code_margin, near
        self.judge = lru_cache(kept)(self._judge)

    def sizes(self, text: str) -> dict[str, int]:
        raw = text.encode("utf-8", "replace")
        return {k: len(c.compress(raw)) for k, c in self.packers.items()}

    def known(self, language: str, words: list[str]) -> int:
        v = self.vocabulary[language]
        return sum(w in v for w in words)

    def language(self, text: str, min_words: int = 4) -> tuple[str | None, int]:
        """(language or None, number of plain words)."""
        words = plain_words(text)
        if len(words) < min_words:
            return None, len(words)
        prose = " ".join(words)
        return self.judge(prose) if len(prose) <= 1000 else self._judge(prose), len(words)

    def _judge(self, prose: str) -> str | None:
        s = self.sizes(f" {prose} ")
        least = min(s.values())
        best = [k for k in sorted(s) if s[k] <= least + self.near]
        if len(best) > 1:
            words = prose.split()
            best.sort(key=lambda k: (-self.known(k, words), s[k]))
        return best[0] if len(self.code.compress(f" {prose} ".encode("utf-8", "replace"))) - s[best[0]] >= self.code_margin else None


def _encode(text: str) -> bytes:
    low = " ".join(text.lower().split())
    plainer = bare(low)
    return (low + " " if plainer == low else plainer + " " + low + " ").encode()


def seed_model(extra_words: Mapping[str, Iterable[str]] | None = None) -> LanguageModel:
    texts = {k: _encode(re.sub(r"[^\w\s'’-]", " ", v)) for k, v in SEED.items()}
    for k, words in (extra_words or {}).items():
        texts[k] = _encode(" ".join(sorted({w for w in words if w}))) + texts[k]
    return LanguageModel(texts, CODE_SEED.lower().encode())


def natural_language_units(df: DataFrame, *, model: LanguageModel | None = None, key: str = "file_id", text: str = "body_text", code_kind: str = "code_kind", min_words: int = 4, extra_words: Mapping[str, Iterable[str]] | None = None, keep_text: bool = True) -> DataFrame:
    """One row per comment or string literal that holds running text of at least `min_words` words.

    Result columns: the key column, `line_no` (from 1, by line feeds), `unit_kind` (comment or string), `lang`, `n_words`,
    `n_chars` (of the readable text) and `unit_text`. NULL or empty texts and unknown code kinds give no rows; repeated
    files give their rows again; `key` may not be named like a result column; texts of any length are read whole; an empty table gives no rows.
    model: dictionaries of one's own; default `seed_model(extra_words)`. keep_text: without it `unit_text` is NULL.
    Tied languages that know equally many words go to the shorter encoding, then to the first by name.
    """
    require(df, key, text, code_kind)
    reject_clash([key], ("line_no", "unit_kind", "lang", "n_words", "n_chars", "unit_text"))
    model = seed_model(extra_words) if model is None else model
    src = df.select(col(key).alias("k"), col(text).alias("t"), col(code_kind).alias("c"))
    kind = src.schema["k"].dataType
    schema = T.StructType([T.StructField("k", kind), T.StructField("line_no", T.LongType()), T.StructField("unit_kind", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("unit_text", T.StringType())])
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    arrow_key = src.select("k").limit(0).toArrow().schema.field(0).type

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident = Identifier(model)
        for b in batches:
            who, rows = [], []
            for i, (t, c) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                for line, unit, body, raw in units(t, c):
                    prose = plain(body, unit, raw)
                    lang, n = ident.language(prose, min_words)
                    if lang is not None:
                        who.append(i)
                        rows.append((line, unit, lang, n, len(prose), prose if keep_text else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int64())).cast(arrow_key), *[pa.array(x, t) for x, t in zip(cols, types, strict=True)]], names=schema.names)

    return src.mapInArrow(kernel, schema).withColumnRenamed("k", key)


def language_shares(df: DataFrame, found: DataFrame, *, key: str = "file_id", text: str = "body_text") -> DataFrame:
    """For every file and language found in it: `n_units`, `lang_chars`, `share_of_file` (of all its characters) and
    `share_of_text` (of its natural-language characters). A file without any has one row with a NULL `lang` and zeros."""
    f = found.groupBy(col(key).alias("_k"), "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("c"))
    total = found.groupBy(col(key).alias("_t")).agg(F.sum("n_chars").alias("a"))
    size = F.length(col(text))
    x = df.select(col(key), size.alias("_size")).join(f, col(key) == F.col("_k"), "left").join(total, col(key) == F.col("_t"), "left")
    zero = F.lit(0)
    return x.select(col(key), "lang", F.coalesce("n", zero).alias("n_units"), F.coalesce("c", zero).alias("lang_chars"), F.when(F.col("_size") > 0, F.coalesce(F.col("c") / F.col("_size"), F.lit(0.0))).otherwise(0.0).alias("share_of_file"), F.when(F.col("a") > 0, F.col("c") / F.col("a")).otherwise(0.0).alias("share_of_text"))
