"""Text rules of subtitles and narration as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pauses in seconds by punctuation mark: fixed values.
PAUSES = {"。": 0.4, "！": 0.4, "？": 0.4, ".": 0.4, "!": 0.4, "?": 0.4, "，": 0.2, ",": 0.2, "、": 0.15, "；": 0.3, ";": 0.3, "：": 0.25, ":": 0.25, "……": 0.5, "...": 0.5, "——": 0.3, "--": 0.3}
#: Words a second of English, characters a second of other languages, and of those that are not listed: fixed values.
SPEECH_RATES = {"zh": 4.0, "en": 2.5, "ja": 5.0, "ko": 4.5}
OTHER_RATE = 4.0


def normalized(text: Column) -> Column:
    """Lower case, without punctuation but for the apostrophe, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s']", " "), r"\s+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens; all tokens as one where there are fewer."""
    last = F.greatest(F.size(tokens) - n + 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens, i, n), " "))


def ascii_share(text: Column) -> Column:
    """Share of ASCII letters among the characters that aren't white space; 0 for none."""
    dense = F.regexp_replace(text, r"\s", "")
    return F.when(F.length(dense) > 0, F.length(F.regexp_replace(dense, "[^A-Za-z]", "")) / F.length(dense)).otherwise(F.lit(0.0))


def clean_ass(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\{[^}]*\}", ""), r"\\[Nn]", " "))


def clean_srt(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), r"\{[^}]*\}", ""))


def pause_seconds(text: Column) -> Column:
    """Pauses that the punctuation asks for; three points count besides their single ones."""
    total = F.lit(0.0)
    for mark, pause in PAUSES.items():
        total = total + (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark) * pause
    return total


def spoken_units(text: Column, lang: Column) -> Column:
    """What a language's speech rate counts: words of English, else letters, digits and underscores."""
    dense = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}_]", ""))
    return F.when(lang == "en", F.size(words(F.regexp_replace(text, r"\s+", " ")))).otherwise(dense)


def speech_seconds(text: Column, lang: Column, speed: float = 1.0) -> Column:
    """Speaking time of text, with pauses; 0 for null or blank text."""
    rate = F.lit(OTHER_RATE)
    for name, value in SPEECH_RATES.items():
        rate = F.when(lang == name, F.lit(value)).otherwise(rate)
    seconds = F.round((spoken_units(text, lang) / rate + pause_seconds(text)) / speed + 1e-9, 2)
    return F.when(F.coalesce(text, F.lit("")).rlike(r"\S"), seconds).otherwise(F.lit(0.0))


def polish_seconds(text: Column, lang: Column) -> Column:
    """Speaking time by 4.1 dense characters a second in Chinese, Japanese and Korean, else by 2.6 words; a tenth at least, 0 for no text."""
    dense = F.length(F.regexp_replace(text, r"\s+", "")) / 4.1
    by_words = F.size(words(F.regexp_replace(text, r"\s+", " "))) / 2.6
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0.0)).otherwise(F.greatest(F.when(lang.isin("zh", "ja", "ko"), dense).otherwise(by_words), F.lit(0.1)))


def client_seconds(text: Column) -> Column:
    """Speaking time by four characters a second, and a fifth of a second for each full-width mark or quotation mark."""
    marks = F.length(F.regexp_replace(text, "[^，。！？、；：（）\"]", ""))
    return F.coalesce(F.round(F.length(text) / 4.0 + marks * 0.2 + 1e-9, 2), F.lit(0.0))


def collapsed(text: Column) -> Column:
    """Repeated marks and white space reduced to one."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"([,.!?])\1+", "$1"), r"\s+", " "))


def safe_name(text: Column, limit: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}._ -]", "_")), r"\s+", "_"), 1, limit)


def file_size(n: Column) -> Column:
    """Bytes for people. Halves of the last digit go to the even one, as in C's printf; Java's would always round them up."""
    part = lambda unit, digits: F.format_string(f"%.{digits}f", F.bround(n / unit, digits))
    return (
        F.when(n < 1024, F.format_string("%d B", n))
        .when(n < 1024**2, F.concat(part(1024.0, 1), F.lit(" KB")))
        .when(n < 1024**3, F.concat(part(1024.0**2, 1), F.lit(" MB")))
        .otherwise(F.concat(part(1024.0**3, 2), F.lit(" GB")))
    )


def fit_words(text: Column, budget: int) -> Column:
    """The most whole sentences from the start within ``budget`` words; the first ``budget`` words where not even one fits."""
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")
    count = lambda s: F.size(words(F.regexp_replace(s, r"\s+", " ")))
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        fits = state["open"] & (state["n"] + count(s) <= budget)
        return F.struct(F.when(fits, state["n"] + count(s)).otherwise(state["n"]).alias("n"), fits.alias("open"), F.when(fits, F.concat(state["out"], F.array(s))).otherwise(state["out"]).alias("out"))

    kept = F.aggregate(sentences, start, step)["out"]
    first = F.array_join(F.slice(words(F.regexp_replace(text, r"\s+", " ")), 1, budget), " ")
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(first)
