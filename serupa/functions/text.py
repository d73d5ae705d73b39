"""Title cleaning and text preparation as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from serupa.config import DEFAULTS, Settings

# Connectors, academic boilerplate, English function words.
STOPWORDS = (
    "dan", "yang", "untuk", "pada", "dengan", "dari", "ke", "di", "ini", "itu", "atau", "sebagai", "dalam", "tentang",
    "oleh", "adalah", "adapun", "serta", "sebuah", "ia", "juga", "rancang", "bangun", "sistem", "aplikasi", "metode",
    "studi", "kasus", "algoritma", "perancangan", "pembuatan", "penerapan", "berbasis", "menggunakan", "analisis",
    "implementasi", "uji", "kinerja", "evaluasi", "pengembangan", "model", "rancangan", "prototipe", "prototype",
    "berbasiskan", "mengimplementasikan", "menganalisis", "berupa", "laporan", "tugas", "akhir", "skripsi", "kerja",
    "praktek", "praktik", "kp", "of", "the", "and", "in", "on", "for", "with", "a", "an", "to", "based", "using",
    "system",
)

# Unicode white space; Java's \s alone is ASCII.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
# k-means, ui/ux and c4.5 become one word; look-behind keeps the word start Unicode-aware on every JVM.
_COMPOUND = r"(?<![\p{L}\p{N}_])([a-z0-9]++)[-/.](([a-z0-9]++)(?![\p{L}\p{N}_]))?"
MIN_WORD = 3


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def title_words(title: Column, dynamic: Iterable[str] = ()) -> Column:
    """Words of a title that carry meaning: lower-case, compounds joined, stopwords and short words dropped."""
    joined = F.regexp_replace(F.lower(title), _COMPOUND, "$1$3")
    plain = F.regexp_replace(joined, "[^a-z0-9]+", " ")
    stop = sorted(set(STOPWORDS).union(dynamic))
    return F.filter(F.split(plain, " "), lambda w: (F.length(w) >= MIN_WORD) & ~w.isin(stop))


def words_or_title(words: Column, title: Column) -> Column:
    """Joined words; a title that cleans to nothing falls back to its stripped original."""
    return F.coalesce(F.nullif(F.array_join(words, " "), F.lit("")), strip(title), F.lit(""))


def clean_title(title: Column, dynamic: Iterable[str] = ()) -> Column:
    return words_or_title(title_words(title, dynamic), title)


def corpus_words(title: Column) -> Column:
    """Distinct words of one title for document frequency; compounds stay split here."""
    return F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit(f"[a-z0-9]{{{MIN_WORD},}}"), F.lit(0)))


def query_text(title: Column) -> Column:
    return strip(title)


def abstract_text(abstract: Column, settings: Settings = DEFAULTS) -> Column:
    """Stripped abstract, cut to the configured length; null when nothing is left."""
    return F.nullif(F.substring(strip(abstract), 1, settings.abstract_max_chars), F.lit(""))


def keyword_text(keywords: Column) -> Column:
    return F.nullif(strip(keywords), F.lit(""))


def index_text(title: Column, abstract: Column, keywords: Column, settings: Settings = DEFAULTS) -> Column:
    """Title, abstract and keywords in one text; an empty part is left out, a blank one is kept as empty."""
    return F.concat_ws(
        " | ",
        strip(title),
        F.when(abstract != "", F.substring(strip(abstract), 1, settings.abstract_max_chars)),
        F.when(keywords != "", strip(keywords)),
    )
