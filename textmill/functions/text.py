"""Scalar text functions: Column -> Column, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop words of content tokens.
STOPWORDS = (
    "a an and are as at be been being but by can could did do does doing for from had has have having he her here hers him his how i if in into is it its "
    "itself just me more most my no nor not of off on once only or other our out over own same she should so some such than that the their them then there "
    "these they this those through to too under until up very was we were what when where which while who whom why will with would you your"
).split()
#: The stop words of content words.
WORD_STOPWORDS = (
    "the and for are was were with that this from into have has had not but its their there which what when where who why how than then them they you your our "
    "out all any can may one two also each such more most other some only own same very will would should could about"
).split()
#: Fixed value: a token.
TOKEN = r"([a-z0-9']+|[^a-z0-9'\s])"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SECRET = r"(?:sk-[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|token = \"[0-9a-f]{40}\"|-----BEGIN [A-Z ]*PRIVATE KEY-----)"


def tokenize(text: Column) -> Column:
    """Lower-cased words of a-z, 0-9 and apostrophes; any other visible character is a token of its own."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def alnum_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))


def content_tokens(text: Column, stop: list[str] = STOPWORDS) -> Column:
    """Alphanumeric tokens that are no stop words."""
    return F.filter(alnum_tokens(text), lambda x: ~x.isin(list(stop)))


def content_words(text: Column, min_length: int = 3, stop: list[str] = WORD_STOPWORDS) -> Column:
    return F.filter(content_tokens(text, stop), lambda x: F.length(x) >= min_length)


def lexicon_hits(text: Column, lexicon: list[str]) -> Column:
    """Lexicon words that the text has, sorted, once each."""
    return F.array_sort(F.array_intersect(alnum_tokens(text), F.array(*map(F.lit, lexicon))))


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at either end."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sentences(text: Column) -> Column:
    """Parts that end in ``.``, ``!`` or ``?`` before white space and an upper-case letter."""
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z])")


def first_sentence(text: Column, most: int = 300) -> Column:
    return F.substring(F.element_at(sentences(collapse(text)), 1), 1, most)


def split_claims(answer: Column) -> Column:
    """Sentences of an answer without its bracketed citations; empty ones are left out."""
    return F.filter(sentences(collapse(F.regexp_replace(answer, r"\[\d+(?:\s*,\s*\d+)*\]", ""))), lambda x: x != "")


def is_abstention(answer: Column, sentence: str) -> Column:
    """Whether the answer is the sentence, but for white space and full stops at the end."""
    return F.rtrim(collapse(answer), F.lit(".")) == F.lit(sentence.rstrip("."))


def cited_ids(answer: Column) -> Column:
    """Numbers in bracketed citations, sorted, once each."""
    groups = F.regexp_extract_all(answer, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r"\s*,\s*"), lambda x: x.cast("int"))))))


def numbers_in(text: Column) -> Column:
    """Runs of digits as they are written, of any length."""
    return F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))


def keyfact_match(answer: Column, facts: Column) -> Column:
    """Whether any key fact is in the answer, case folded; null without facts."""
    return F.when(F.size(facts) > 0, F.exists(facts, lambda f: F.contains(F.lower(answer), F.lower(f))))


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({EMAIL})"), F.lit(1))


def proposed_email(text: Column) -> Column:
    """The address, if the text has exactly one."""
    found = F.array_distinct(emails(text))
    return F.when(F.size(found) == 1, found[0])


def has_secret(text: Column) -> Column:
    return F.rlike(text, F.lit(SECRET))


def clean_markup(html: Column) -> Column:
    """Text of a page: scripts, styles and comments go, tags become spaces, white space collapses."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return collapse(F.regexp_replace(bare, r"(?s)<[^>]*>", " "))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)(?:href|src)="([^"]*)\""""), F.lit(1))


def longest_word(text: Column, least: int = 6) -> Column:
    """The longest word of at least so many letters, the first in the alphabet of several; null without one."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]+)"), F.lit(1)), lambda w: F.length(w) >= least)
    return F.array_min(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))["w"]


def approx_tokens(characters: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(characters / 4)


def duration_text(seconds: Column) -> Column:
    """``45 s``, ``3 min 05 s`` or ``2 h 07 min``."""
    s = F.round(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit(" s")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" min "), two(s % 60), F.lit(" s")))
        .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit(" h "), two(F.floor(s / 60) % 60), F.lit(" min")))
    )


def ordinal_date(day: Column) -> Column:
    """``March 1st, 2024``."""
    n = F.dayofmonth(day)
    suffix = F.when(n.isin(11, 12, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(F.date_format(day, "MMMM "), n.cast("string"), suffix, F.date_format(day, ", yyyy"))


#: Names of months.
MONTHS = "january february march april may june july august september october november december".split()


def extract_date(text: Column) -> Column:
    """The first date of a text as an ISO date: yyyy-mm-dd, else ``4th of May 2026``, else ``May 4, 2026``; null without one."""
    low, names = F.lower(text), "|".join(MONTHS)
    iso = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)
    forms = [(rf"(\d{{1,2}})(?:st|nd|rd|th)? (?:of )?({names}) (\d{{4}})", 1, 2), (rf"({names}) (\d{{1,2}}), (\d{{4}})", 2, 1)]

    def spelled(pattern: str, day: int, month: int) -> Column:
        number = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(low, pattern, month))
        two = lambda c: F.lpad(c, 2, "0")
        found = F.concat_ws("-", F.regexp_extract(low, pattern, 3), two(number.cast("string")), two(F.regexp_extract(low, pattern, day)))
        return F.when((number > 0) & F.try_to_date(found, "yyyy-MM-dd").isNotNull(), found)

    return F.coalesce(F.when(iso != "", iso), *(spelled(*f) for f in forms))


def is_iso_date(text: Column) -> Column:
    """Of the form yyyy-mm-dd, and a day of the calendar."""
    return F.coalesce(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}$")) & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def tiered_refund(days_before: Column, paid: Column) -> Column:
    """All of a whole-number payment from 14 days before, half rounded down from 7, else nothing."""
    return F.when(days_before >= 14, paid).when(days_before >= 7, F.floor(paid / 2)).otherwise(F.lit(0)).cast("long")


def error_kind(content: Column) -> Column:
    """The kind of a logged message by its beginning."""
    return (
        F.when(content.startswith("Error: timeout"), "timeout")
        .when(content.startswith("Error:"), F.regexp_extract(content, r"^Error: (\w+)", 1))
        .otherwise("none")
    )


def parse_decision(reply: Column, options: list[str]) -> Column:
    """answer and confidence of a JSON reply: the answer must be an option, the confidence a number from 0 to 1 or a
    percentage as a string; anything else is null."""
    fields = F.from_json(reply, "answer string, confidence string")
    raw = F.get_json_object(reply, "$.confidence")
    percent = F.regexp_extract(fields["confidence"], r"^\s*(\d+(?:\.\d+)?)\s*%\s*$", 1)
    value = F.when(percent != "", percent.try_cast("double") / 100).when(~raw.isin("true", "false"), fields["confidence"].try_cast("double"))
    return F.struct(
        F.when(fields["answer"].isin(options), fields["answer"]).alias("answer"),
        F.when((value >= 0) & (value <= 1), value).alias("confidence"),
    )
