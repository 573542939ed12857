"""Row-wise expressions over strings: all Column to Column, all in the JVM, but for full Unicode folding."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weft.functions import vocab

_MARKED = "àáâãäåèéêëìíîïòóôõöùúûüýÿñçÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝÑÇ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuyyncAAAAAAEEEEIIIIOOOOOUUUUYNC"


def any_of(value: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | value.rlike(p)
    return out


def lookup(value: Column, mapping: dict) -> Column:
    """The value that mapping has for each value, null where it has none."""
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), value)


# --- identifiers and labels ---


@F.arrow_udf(StringType())
def _fold_id(values: pa.Array) -> pa.Array:
    import re

    def fold(s):
        return None if s is None else re.sub(r"_+", "_", re.sub(r"[^\w]+", "_", unicodedata.normalize("NFKC", s))).strip("_").casefold()

    return pa.array([fold(s) for s in values.to_pylist()], pa.string())


def norm_id(value: Column) -> Column:
    """An identifier: compatibility-composed, runs of non-word characters as one underscore, case folded.

    Values in ASCII, nearly all, stay in the JVM; only the others go to Python for Unicode folding.
    """
    ascii_only = F.lower(F.trim(F.regexp_replace(value, r"[^a-zA-Z0-9]+", "_"), F.lit("_")))
    return F.when(value.rlike(r"^\p{ASCII}*$"), ascii_only).otherwise(_fold_id(F.when(~value.rlike(r"^\p{ASCII}*$"), value)))


def norm_label(value: Column) -> Column:
    """A label for entity matching: lower case, every run of non-word characters and underscores as one space."""
    return F.trim(F.regexp_replace(F.lower(value), r"(?U)[\W_]+", " "))


def plain_letters(value: Column) -> Column:
    """Without the diacritics of Latin letters."""
    return F.translate(value, _MARKED, _PLAIN)


def search_tokens(value: Column) -> Column:
    return F.regexp_extract_all(F.lower(plain_letters(value)), F.lit(r"(?U)\w+"), F.lit(0))


def bare_name(value: Column) -> Column:
    """A callable's name without its decoration: no leading dot, no brackets, lower case."""
    return F.lower(F.regexp_replace(F.trim(value), r"^\.|\(\)$", ""))


def label_clean(value: Column, most: int = 256) -> Column:
    return F.substring(F.regexp_replace(value, r"[\x00-\x1f\x7f]", ""), 1, most)


def shingles(value: Column, k: int = 3) -> Column:
    """Distinct k-character pieces; a shorter value is its own piece."""
    pieces = F.transform(F.sequence(F.lit(1), F.length(value) - (k - 1)), lambda i: F.substring(value, i, F.lit(k)))
    return F.when(F.length(value) >= k, F.array_distinct(pieces)).otherwise(F.array(value))


def entropy_bits(value: Column) -> Column:
    """Shannon entropy of the characters, in bits a character; 0 for an empty value."""
    chars = F.split(value, "")
    n = F.length(value)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    bits = F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return F.when(n > 0, bits).otherwise(0.0)


def snake_stem_hash(value: Column, digits: int = 8) -> Column:
    """An ASCII identifier that stays unique: a slug and the first digits of the value's hash."""
    slug = F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.concat(slug, F.lit("_"), F.substring(F.sha1(value.cast("binary")), 1, digits))


# --- paths ---


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last extension of the file's name, with its dot, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def top_dir(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def parents(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def language_family(path: Column) -> Column:
    return lookup(extension(path), vocab.LANGUAGE_FAMILY)


def file_category(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(*vocab.CODE_EXTENSIONS), "code").when(ext.isin(*vocab.PAPER_EXTENSIONS), "paper").when(ext.isin(*vocab.IMAGE_EXTENSIONS), "image").otherwise("doc")


def paper_signals(text: Column) -> Column:
    """How many of the signals of an academic paper the first 3,000 characters show."""
    head = F.substring(text, 1, 3000)
    out = F.lit(0)
    for p in vocab.PAPER_SIGNALS:
        out = out + head.rlike(p).cast("int")
    return out


def classify_file(path: Column, text: Column) -> Column:
    """code, document, paper, image or video; null for other files. A script without extension is code by its first line."""
    ext = extension(path)
    first = F.substring_index(text, "\n", 1)
    script = first.rlike(r"^#!.*\b(python|bash|sh|zsh|node|ruby|perl|lua|php|julia|Rscript|pwsh|fish|dash|ksh|tclsh)[0-9.]*\b")
    return (
        F.when(ext == "", F.when(script, "code"))
        .when(ext.isin(*vocab.CODE_EXTENSIONS), "code")
        .when(ext.isin(*vocab.PAPER_EXTENSIONS), F.when(~path.rlike(r"\.(imageset|xcassets|appiconset|colorset|launchimage)/"), "paper"))
        .when(ext.isin(*vocab.IMAGE_EXTENSIONS), "image")
        .when(ext.isin(*vocab.DOC_EXTENSIONS), F.when(paper_signals(text) >= 3, "paper").otherwise("document"))
        .when(ext.isin(*vocab.OFFICE_EXTENSIONS), "document")
        .when(ext.isin(*vocab.VIDEO_EXTENSIONS), "video")
    )


def is_sensitive(path: Column) -> Column:
    """Whether a file likely holds secrets: by its directories, by its name, or by a word that names its contents."""
    name, ext = basename(path), extension(path)
    source = ext.isin(*[e for e in vocab.CODE_EXTENSIONS if e not in vocab.SECRET_PRONE])
    stem = F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), r"^\.+", "")
    words = F.size(F.filter(F.split(stem, r"[-_\s.]+"), lambda w: w != ""))
    hit, whole, ends = F.lit(False), F.lit(False), F.lit(False)
    for w in vocab.SECRET_WORDS:
        hit = hit | stem.rlike(f"(?i)(?<![a-zA-Z0-9])({w})(?![a-zA-Z])")
        ends = ends | stem.rlike(f"(?i)(?<![a-zA-Z0-9])({w})$")
        whole = whole | stem.rlike(f"(?i)^({w})$")
    named = (ends | (hit & (words <= 2))) & ~(source | (ext.isin(*vocab.PROSE_EXTENSIONS) & ~whole))
    low = F.transform(parents(path), F.lower)
    return (
        F.arrays_overlap(low, F.array(*map(F.lit, vocab.CREDENTIAL_DIRS)))
        | (F.arrays_overlap(low, F.array(*map(F.lit, vocab.SECRET_DIRS))) & ~source)
        | (any_of(name, vocab.SECRET_NAMES) & ~name.rlike(vocab.ENV_TEMPLATE))
        | named
    )


def is_test_path(path: Column) -> Column:
    inside = F.exists(F.split(path, "/"), lambda s: F.lower(s).isin(*vocab.TEST_DIRS))
    return inside | basename(path).rlike(vocab.TEST_NAMES) | basename(path).rlike(vocab.TEST_NAMES_CASED)


# --- values ---


def file_type(value: Column) -> Column:
    """A file type of the vocabulary: synonyms folded, all else a concept."""
    return F.when(value.isin(*vocab.FILE_TYPES), value).otherwise(F.coalesce(lookup(value, vocab.FILE_TYPE_SYNONYMS), F.lit("concept")))


def confidence_score(score: Column, confidence: Column) -> Column:
    return F.coalesce(score, lookup(confidence, vocab.CONFIDENCE_SCORES), F.lit(1.0))


def weight(value: Column) -> Column:
    """A finite weight of 0 or more; 1 for anything else."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number) | (number < 0) | (number == float("inf")), 1.0).otherwise(number)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """What a model's call costs, at prices for a million tokens; 0 where a price is not known."""
    return F.coalesce((tokens_in * price_in + tokens_out * price_out) / 1_000_000, F.lit(0.0))


def is_sentence(value: Column) -> Column:
    """Whether a label reads like prose: 80 characters or 8 words or more, and an end of a sentence or a colon."""
    trimmed = F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", "")
    long = (F.length(trimmed) >= 80) | (F.coalesce(word_count(trimmed), F.lit(0)) >= 8)
    return long & trimmed.rlike("[.!?:]")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("long")


def content_hash(text: Column, path: Column) -> Column:
    return F.sha2(F.concat(text.cast("binary"), F.unhex(F.lit("00")), path.cast("binary")), 256)


def url_type(url: Column) -> Column:
    low = F.lower(url)
    path = F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return (
        F.when(low.contains("twitter.com") | low.contains("x.com"), "tweet")
        .when(low.contains("arxiv.org"), "arxiv")
        .when(low.contains("github.com"), "github")
        .when(low.contains("youtube.com") | low.contains("youtu.be"), "youtube")
        .when(path.endswith(".pdf"), "pdf")
        .when(path.rlike(r"\.(png|jpg|jpeg|webp|gif)$"), "image")
        .otherwise("webpage")
    )


def html_text(html: Column) -> Column:
    """The text of a page: scripts, styles and tags gone, white space folded."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]+>", " "), r"[ \t\n\r\f\x0B]+", " "))


def cypher_string(value: Column) -> Column:
    out = F.regexp_replace(value, r"[\x00-\x1f\x7f]", " ")
    return F.replace(F.replace(out, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def yaml_string(value: Column) -> Column:
    out = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.regexp_replace(out, r"[\r\n\t]+", " "), F.lit('"'))


def decay(age_days: Column, half_life: float = 30.0) -> Column:
    """The weight of something so many days old; without a date 1, in the future 1."""
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days) / half_life), F.lit(1.0))


def query_terms(question: Column) -> Column:
    """Searchable terms of a question: words, English ones of three letters and more, without stop words unless only such are left."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"(?U)\w+"), F.lit(0))
    terms = F.filter(words, lambda w: ~w.rlike("^[a-z]{1,2}$"))
    content = F.filter(terms, lambda w: ~w.isin(*vocab.STOPWORDS))
    return F.when(F.size(content) > 0, content).otherwise(terms)


def context_filters(question: Column) -> Column:
    """The edge contexts that a question's words hint at, in the vocabulary's order."""
    words = F.split(F.translate(F.lower(plain_letters(question)), "?,", "  "), r"\s+")
    hits = [F.when(F.arrays_overlap(words, F.array(*map(F.lit, hints))), F.lit(name)) for name, hints in vocab.CONTEXT_HINTS.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())
