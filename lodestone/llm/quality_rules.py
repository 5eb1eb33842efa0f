"""Line-first cleaning: rules judge lines, failing lines go, and documents that lose too much text are rejected.

Rules on a line that has a word (the first that fails counts):
  punctuation  a quarter or more of the words carry runs of symbols or of ``!``; or a line of ``long_line`` words or
               more has no punctuation at all;
  navigation   a list of links or cells: two or more separators, with few words between them;
  boilerplate  a fixed phrase of site furniture, on a line of at most ``furniture_words`` words.
Everything is counted within a text, so each task works on a bounded slice of rows and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, table
from .words import Tokens, inner, mix, text_slices, windows

# Symbols, separators and phrases.
SYMBOLS = b"#*$%&|<>"
_MARKED = re.compile(rb"[#*$%&<>]{2,}|!!+")
_SEPARATOR = re.compile(rb"\||\xc2\xbb|\xe2\x80\xba|\xc2\xb7|\xe2\x80\xa2")
_PUNCTUATION = re.compile(rb"[.,;:!?'\"()-]|\xe2\x80[\x93-\xa6]|\xe3\x80\x82|\xef\xbc\x8c")
#: In the corpus's languages: English, German, French, Spanish.
_FURNITURE = re.compile("all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|use cookies|skip to (?:main )?content|sign in|log in|subscribe (?:now|to)|share (?:this|on)|read more|click here|enable javascript|powered by|copyright ©|back to top"
    "|alle rechte vorbehalten|datenschutz(?:erklärung|richtlinie)|nutzungsbedingungen|zum inhalt springen|jetzt anmelden|weiterlesen|nach oben"
    "|tous droits réservés|politique de confidentialité|conditions d'utilisation|aller au contenu|se connecter|lire la suite|haut de page"
    "|todos los derechos reservados|política de privacidad|condiciones de uso|saltar al contenido|iniciar sesión|leer más|volver arriba".encode(), re.I)  # fmt: skip
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def line_fault(line: bytes, n: int, *, long_line: int, furniture_words: int) -> str | None:
    """The rule that a line of n > 0 words breaks, if any."""
    if 4 * len(_MARKED.findall(line)) >= n and _MARKED.search(line):
        return "punctuation"
    if n >= long_line and not _PUNCTUATION.search(line):
        return "punctuation"
    cells = len(_SEPARATOR.findall(line))
    if cells >= 2 and n <= 5 * (cells + 1):
        return "navigation"
    if n <= furniture_words and _FURNITURE.search(line):
        return "boilerplate"
    return None


def _judge(most_lost: float, long_line: int, furniture_words: int) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lost_lines", "n_lost_words", "n_lost_chars", "cleaned")}
            for _, texts in text_slices(batch):
                x = Tokens(texts)
                b = np.frombuffer(x.raw, np.uint8)
                total = lambda mask, x=x: np.diff(np.concatenate([[0], np.cumsum(mask)])[x.base]).tolist()
                out["n_words"] += x.lengths.tolist()
                out["word_chars"] += total(_FIRST_BYTE[b] & ~_SPACE[b])
                out["n_symbols"] += total(_SYMBOL[b])
                out["n_repeat_words"] += _repeat_words(x)
                for t in texts:
                    seen: set[bytes] = set()
                    dup = lines = lost = lost_words = lost_chars = 0
                    kept = []
                    for line in (t or b"").split(b"\n"):
                        n = len(line.split())
                        if not n:
                            kept.append(line)
                            continue
                        lines += 1
                        if line in seen:
                            dup += 1
                        else:
                            seen.add(line)
                        if line_fault(line, n, long_line=long_line, furniture_words=furniture_words):
                            lost += 1
                            lost_words += n
                            lost_chars += len(line.decode("utf-8", "replace"))
                        else:
                            kept.append(line)
                    out["n_dup_lines"].append(dup)
                    out["n_lines"].append(lines)
                    out["n_lost_lines"].append(lost)
                    out["n_lost_words"].append(lost_words)
                    out["n_lost_chars"].append(lost_chars)
                    out["cleaned"].append(b"\n".join(kept) if t is not None else None)
            failed = [w < 50 or 100 * r > 50 * w for w, r in zip(out["n_words"], out["n_repeat_words"], strict=True)]
            kept_ = [not f and lw <= most_lost * w for f, lw, w in zip(failed, out["n_lost_words"], out["n_words"], strict=True)]
            cleaned = pa.array(out.pop("cleaned"), pa.large_binary()).cast(pa.large_string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.int64()) for v in out.values()), pa.array(failed, pa.bool_()), pa.array(kept_, pa.bool_()), cleaned], names=["doc_id", *out, "base_failed", "kept", "cleaned_text"])

    return f


def _repeat_words(x: Tokens, n: int = 3) -> list[int]:
    """Per text, words in an n-word window that is found twice or more in the text."""
    h, ok = windows(x.ids, n), inner(x.lengths, n)
    gone = np.zeros(len(x.ids) + 1, np.int64)
    if ok.any():
        text = np.repeat(np.arange(len(x.lengths), dtype=np.uint64), x.lengths)[: len(h)]
        h = (h ^ mix(text + np.uint64(1)))[ok]
        at = np.flatnonzero(ok)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        many = np.zeros(len(h), bool)
        many[order[1:][same]] = True
        many[order[:-1][same]] = True
        np.add.at(gone, at[many], 1)
        np.add.at(gone, at[many] + n, -1)
    return np.diff(np.concatenate([[0], np.cumsum(np.cumsum(gone)[:-1] > 0)])[x.first]).tolist()


_SCHEMA = "doc_id bigint, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_lost_lines long, n_lost_words long, n_lost_chars long, base_failed boolean, kept boolean, cleaned_text string"


def clean_lines(docs: DataFrame, *, most_lost: float = 0.4, long_line: int = 30, furniture_words: int = 20) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): base counts, line counts, the verdict and the cleaned text.

    Null texts have no words, fail the base rules and have no cleaned text; empty texts are the same with an empty one.
    Rows are judged alone, so repeats and ties are judged alike; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_judge(most_lost, long_line, furniture_words), _SCHEMA)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; see ``clean_lines`` for nulls, empties and repeats."""
    out = clean_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lost_lines", "n_lost_words", "n_lost_chars", F.sha2(F.coalesce("cleaned_text", F.lit("")), 256).alias("cleaned_sha256"))
