"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and digits with one standard form.
LETTER_FORMS = "يكةۀؤإأٱ"
LETTER_STANDARD = "یکههوااا"
DIGITS_OTHER = "٠١٢٣٤٥٦٧٨٩0123456789"
DIGITS_OWN = "۰۱۲۳۴۵۶۷۸۹۰۱۲۳۴۵۶۷۸۹"
DIACRITICS = "[ً-ٰٟ]"

# What personal data looks like, in the order of replacement.
PII = (
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("PHONE", r"(?:\+98|0)?9\d{9}\b"),
    ("NATIONAL_ID", r"\b\d{10}\b"),
    ("CARD", r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b"),
    ("IP", r"\b\d{1,3}(?:\.\d{1,3}){3}\b"),
)
URL = r"https?://\S+|www\.\S+"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row: inside a lambda an
    expression would be computed again for every element."""
    return F.transform(F.array(value), body)[0]


def normalize(text: Column) -> Column:
    """One form of letters and digits, no diacritics, single spaces."""
    out = F.translate(F.translate(text, LETTER_FORMS, LETTER_STANDARD), DIGITS_OTHER, DIGITS_OWN)
    return F.trim(F.regexp_replace(F.regexp_replace(out, DIACRITICS, ""), r"\s+", " "))


def squeeze_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean(text: Column) -> Column:
    """Without URLs, addresses, tags and control characters; long runs of a character become two."""
    out = F.regexp_replace(text, URL, "")
    for pattern in (PII[0][1], r"<[^>]+>"):
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(out, r"(.)\1{3,}", "$1$1")
    return squeeze_space(F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def without_unwanted(text: Column) -> Column:
    """URLs, mentions, hashtags, addresses, tags and long runs are deleted."""
    out = text
    for pattern in (URL, PII[0][1], r"[@#]\w+", r"<[^>]+>", r"(.)\1{3,}"):
        out = F.regexp_replace(out, pattern, "")
    return squeeze_space(out)


def redact(text: Column, rules=PII) -> Column:
    """Each rule's matches become its name in brackets, in order."""
    for name, pattern in rules:
        text = F.regexp_replace(text, pattern, f"[{name}]")
    return text


def is_safe(text: Column, rules=PII) -> Column:
    out = F.lit(True)
    for _, pattern in rules:
        out = out & ~text.rlike(pattern)
    return out


def scrub(text: Column, rules=PII) -> Column:
    """Each match becomes [NAME_hash8]; equal values get equal marks."""

    def mark(name: str):
        return lambda t, m: F.replace(t, m, F.concat(F.lit(f"[{name}_"), F.substring(F.sha2(m, 256), 1, 8), F.lit("]")))

    def step(name: str, pattern: str):
        def of(t: Column) -> Column:
            found = F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
            longest = F.array_sort(found, lambda a, b: F.length(b) - F.length(a))
            return F.aggregate(longest, t, mark(name))

        return of

    for name, pattern in rules:
        text = let(text, step(name, pattern))
    return text


def sentences(text: Column) -> Column:
    """Split after sentence ends; the marks stay with their sentence."""
    parts = F.split(F.trim(text), r"(?<=[.!?؟])\s+")
    return F.filter(parts, lambda s: F.length(F.trim(s)) > 0)


def sentences_plain(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[.!?؟]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.trim(text), r"\s+"), "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w+\b"), F.lit(0))


def script_share(text: Column, script: str = "[؀-ۿ]") -> Column:
    """Share of word characters in a script; 0 without word characters."""
    n = F.length(F.regexp_replace(text, r"(?U)\W+", ""))
    own = F.length(text) - F.length(F.regexp_replace(text, script, ""))
    return F.when(n > 0, own / F.when(n > 0, n)).otherwise(0.0)


def statistics(text: Column) -> dict[str, Column]:
    w = words(text)
    n = F.size(w)
    return {
        "n_chars": F.length(text),
        "n_words": n,
        "n_distinct": F.size(F.array_distinct(w)),
        "n_sentences": F.size(sentences_plain(text)),
        "mean_word": F.when(n > 0, F.length(F.array_join(w, "")) / F.when(n > 0, n)).otherwise(0.0),
    }


def truncate(text: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - len(mark)), F.lit(mark)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / F.when(union > 0, union)).otherwise(1.0)


def overlap(part: Column, whole: Column) -> Column:
    """Share of the distinct items of part that whole has."""
    n = F.size(F.array_distinct(part))
    return F.when(n > 0, F.size(F.array_intersect(part, whole)) / F.when(n > 0, n)).otherwise(0.0)


def ngrams(items: Column, n: int) -> Column:
    def of(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, made).otherwise(F.array().cast("array<string>"))

    return let(items, of)


def dates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b"), F.lit(0))


def first_number(text: Column, *patterns: str) -> Column:
    """The first group of the first pattern that matches, as a number, else 0."""
    got = [F.when(text.rlike(p), F.regexp_extract(text, p, 1).cast("int")) for p in patterns]
    return F.coalesce(*got, F.lit(0))


def canonical_id(kind: str, **fields: Column) -> Column:
    """kind_ + 48 hex digits of the hash of the fields as JSON in name order."""
    body = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))
    return F.concat(F.lit(kind + "_"), F.substring(F.sha2(body, 256), 1, 48))


def classify(text: Column, rules: list[tuple[str, str]], default: str) -> tuple[Column, Column]:
    """(label, confidence): the first pattern that matches at .9, else the default at .5."""
    label = F.coalesce(*[F.when(text.rlike(p), F.lit(name)) for name, p in rules], F.lit(default))
    sure = F.lit(False)
    for _, p in rules:
        sure = sure | text.rlike(p)
    return label, F.when(sure, 0.9).otherwise(0.5)


def route(text: Column, rules: dict[str, dict[str, float]], default: str) -> Column:
    """struct(score, label) of the label with the largest sum of weights of terms found; ties to the first listed."""
    scored = []
    for i, (label, terms) in enumerate(rules.items()):
        total = F.lit(0.0)
        for term, w in terms.items():
            total = total + F.when(text.contains(term), w).otherwise(0.0)
        scored.append(F.struct(total.alias("score"), F.lit(-i).alias("place"), F.lit(label).alias("label")))
    best = F.array_max(F.array(*scored))
    return F.when(best["score"] > 0, best["label"]).otherwise(default)


def complexity(text: Column, terms: list[str], flags: list[tuple[str, float]]) -> Column:
    """1.5 per term, .5 per word, and the weight of each flag that occurs."""
    total = 0.5 * F.size(words(text))
    for t in terms:
        total = total + F.when(text.contains(t), 1.5).otherwise(0.0)
    for f, w in flags:
        total = total + F.when(text.contains(f), w).otherwise(0.0)
    return total


def contradicts(a: Column, b: Column, antonyms: dict[str, str], negations: list[str]) -> Column:
    """An antonym pair across two token arrays, or just one side negated with a common word."""
    out = F.lit(False)
    for x, y in antonyms.items():
        out = out | (F.array_contains(a, x) & F.array_contains(b, y)) | (F.array_contains(a, y) & F.array_contains(b, x))
    neg = F.array(*[F.lit(n) for n in negations])
    one = F.arrays_overlap(a, neg) != F.arrays_overlap(b, neg)
    return out | (one & F.arrays_overlap(a, b))
