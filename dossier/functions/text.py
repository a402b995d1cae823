"""Row-local text expressions: Column in, Column out, no Python per row.

``fold`` is the common first step.  It lower-cases and rewrites every letter or
digit outside ASCII to ``_`` (a word character that is in no pattern), and
every Unicode space to a plain one.  After it, the ASCII meaning of ``\\w``,
``\\b`` and ``\\s`` is the Unicode meaning on the original text, whatever the
Java version.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier import lexicon as L
from dossier.functions.numeric import let

BLANKS = " \t\n\r\f\x0b"
# both ask for a character outside ASCII first: the test of a category costs many times that
FOREIGN_WORD_CHAR = r"[\x{80}-\x{10FFFF}&&[^\p{P}\p{S}\p{Z}\p{M}\p{C}]]"
FOREIGN_SPACE = r"[\x{80}-\x{10FFFF}&&[\p{Z}\x{85}]]"


def fold(text: Column) -> Column:
    """Lower-case; non-ASCII word characters become '_' and spaces ' '."""
    low = F.lower(F.coalesce(text, F.lit("")))
    folded = F.regexp_replace(F.regexp_replace(low, FOREIGN_WORD_CHAR, "_"), FOREIGN_SPACE, " ")
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(folded)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def norm_key(col: Column) -> Column:
    """Key normalisation: trimmed and lower-cased."""
    return F.lower(strip(col))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


_WORDS = re.compile(r"[a-z0-9 ]+")


def openings(pattern: str) -> list[str]:
    """Literal words one of which any match must hold; empty when unknown.

    Understands patterns that open with a word or a choice of words.
    """
    head = re.sub(r"^\\b", "", pattern.split(".*")[0])
    if head.startswith("(?:"):
        head = head[3:head.find(")")]
    words = [re.sub(r"\\b$", "", w) for w in head.split("|")]
    return words if all(_WORDS.fullmatch(w) for w in words) else []


def found(text: Column, pattern: str) -> Column:
    """Pattern search in which '.' stops at a line feed only.

    A plain substring test comes first: it is many times cheaper than a regular
    expression, and alone it settles patterns that are nothing but words.
    """
    words = openings(pattern)
    if words and "|".join(words) == pattern:
        return contains_any(text, words)
    search = text.rlike("(?d)" + pattern)
    return contains_any(text, words) & search if words else search


def at_word(pattern: str) -> str:
    """The same pattern, tried only where a word begins with one of its first characters.

    Understands patterns that open with a boundary and a choice of words (or digits); others come
    back as they are.  A boundary before a word character has none of ``[a-z0-9_]`` before it, and
    both tests cost far less than the boundary itself.
    """
    opened = re.match(r"\\b(\((?:\?:)?|)", pattern)
    inner = pattern[opened.end():] if opened else ""
    depth, choices = 1, [0]
    for at, ch in enumerate(inner if opened and opened[1] else ""):
        if inner[at - 1:at] == "\\":
            continue
        depth += (ch == "(") - (ch == ")")
        if depth == 0:
            inner, after = inner[:at], inner[at + 1:]
            if re.match(r"[?*{]", after) or "|" in re.sub(r"\([^()]*\)", "", after):
                return pattern
            break
        if ch == "|" and depth == 1:
            choices.append(at + 1)
    if opened and not opened[1] and "|" in inner:
        return pattern
    first = [re.match(r"(\\d|[a-z0-9])(?![?*]|\{0)", inner[at:]) for at in choices]
    if not all(first):
        return pattern
    return f"(?=[{''.join(sorted({f[1] for f in first}))}])(?<![a-z0-9_]){pattern}"


def flag(condition: Column) -> Column:
    return condition.cast("int")


def total(columns) -> Column:
    return reduce(add, columns)


def any_of(conditions) -> Column:
    return reduce(or_, conditions)


def constant(value, shape: str) -> Column:
    """A constant array or map as one small expression, folded by the optimizer."""
    return F.from_json(F.lit(json.dumps(value)), shape)


def word_list(words) -> Column:
    return constant(list(words), "array<string>")


def contains_any(text: Column, words) -> Column:
    """Whether any of the words occurs as a substring."""
    if len(words) == 1:
        return text.contains(words[0])
    return let(text, lambda t: F.exists(word_list(words), lambda w: F.contains(t, w)))


def contained(text: Column, words) -> Column:
    """Number of the words that occur as a substring."""
    return let(text, lambda t: F.size(F.filter(word_list(words), lambda w: F.contains(t, w))))


# ---------------------------------------------------------------- tokens

def word_count(text: Column) -> Column:
    """Whitespace-separated words; 0 for blank text.

    Split at plain spaces, which needs no regular expression, after the other blanks became some.
    """
    spaced = reduce(lambda t, ch: F.replace(t, F.lit(ch), F.lit(" ")), BLANKS[1:], text)
    return F.array_size(F.array_remove(F.split(spaced, " "), ""))


def content_words(folded: Column) -> Column:
    """Words of three or more plain letters minus stopwords, in text order."""
    stop = [w for w in L.CONTENT_STOPWORDS if len(w) > 2]
    by_first = "|".join(
        f"{ch}(?:{'|'.join(w[1:] for w in stop if w[0] == ch)})" for ch in sorted({w[0] for w in stop}))
    return F.regexp_extract_all(folded, F.lit(
        rf"(?<![a-z0-9_])(?=[a-z])\b(?!(?:{by_first})\b)([a-z]{{3,}})\b"))


def tech_tokens(folded: Column) -> Column:
    """Distinct tokens that may hold digits, '+', '#' and '.', minus stopwords."""
    raw = F.regexp_extract_all(folded, F.lit(
        r"(?<![a-z0-9_])(?=[a-z])\b([a-z][a-z0-9+#.]+)\b"))
    return F.array_except(raw, word_list(L.TECH_STOPWORDS))


def fragments(folded: Column) -> Column:
    """Sentences and bullets, trimmed, blanks dropped."""
    parts = F.transform(F.split(folded, r"[.!?\n•\t-]"), strip)
    return F.filter(parts, lambda p: p != "")


def filled_lines(folded: Column) -> Column:
    return count_of(folded, r"\S[^\n]*")


def words_per_line(folded: Column, words: Column | None = None) -> Column:
    """Mean number of words per non-blank line, null for blank text; ``words``: their number."""
    words = word_count(folded) if words is None else words
    return F.try_divide(words.cast("double"), filled_lines(folded))


def count_items(col: Column) -> Column:
    """Non-blank items of a comma list; 0 for null or blank."""
    parts = F.split(F.coalesce(col, F.lit("")), ",")
    return F.size(F.filter(parts, lambda p: strip(p) != ""))


def scrub_text(text: Column) -> Column:
    """Drop instruction phrases, then keep the review window of 2000 characters."""
    return F.substring(F.regexp_replace(text, L.SCRUB_PATTERN, ""), 1, L.SCRUB_LENGTH)


def education_context(folded: Column) -> Column:
    """The part after the first education heading, up to the next heading; else
    200 characters either side of the first hint; else the whole text."""
    reach = L.EDUCATION_HINT_REACH

    def around(pattern: str) -> Column:
        search = F.lit(at_word(pattern))
        hit = F.regexp_instr(folded, search)
        start = F.greatest(F.lit(1), hit - reach)
        stop = hit + F.length(F.regexp_substr(folded, search)) + reach
        return F.when(hit > 0, F.substr(folded, start, stop - start))

    hints = [around(p) for p in L.EDUCATION_HINTS]
    return F.coalesce(F.get(F.split(folded, at_word(L.EDUCATION_HEADING_SPLIT)), F.lit(1)), *hints, folded)


# ------------------------------------------------------- pattern counts

def achievement_count(folded: Column) -> Column:
    """Figures and action verbs, every occurrence, capped at 50.

    The verbs carry no leading boundary, so a verb that ends in another verb
    counts for both.  One scan finds the ends of the verbs that end in no other
    one; the rest are searched where they occur.
    """
    verbs = L.ACHIEVEMENT_VERBS
    longer = [v for v in verbs if any(v != other and v.endswith(other) for other in verbs)]
    roots = [v for v in verbs if v not in longer]
    ends = rf"(?:{'|'.join(sorted({v[-2:] for v in roots}))})\b(?<=(?:{'|'.join(roots)}))"

    def counted(part: str, pattern: str) -> Column:
        return F.when(folded.contains(part), count_of(folded, pattern)).otherwise(F.lit(0))

    return F.least(total([
        F.coalesce(count_of(folded, ends), F.lit(0)), *[counted(v, v + r"\b") for v in longer],
        *[counted(sign, at_word(p)) for sign, p in zip("%x$", L.ACHIEVEMENT_FIGURES)]]), F.lit(50))


def certification_count(folded: Column) -> Column:
    """Number of certification patterns present, capped at 30."""
    return F.least(total([flag(found(folded, p)) for p in L.CERTIFICATION_PATTERNS]), F.lit(30))


def education_level(folded: Column) -> Column:
    ladder = F
    for level, pattern in L.EDUCATION_LEVELS:
        ladder = ladder.when(folded.rlike(at_word(pattern)), F.lit(level))
    return ladder.otherwise(F.lit(L.EDUCATION_DEFAULT))


def has_previous_job(folded: Column, text: Column) -> Column:
    """1 when any of four kinds of evidence of earlier employment is present.

    Date-range strings are compared as written, so they come from ``text``.
    """
    spans = F.regexp_extract_all(
        text, F.lit(r"(?i)(" + L.YEAR_ANYWHERE + r"\s*[-–—]\s*(?:present|current|"
                    + L.YEAR_ANYWHERE + "))"))
    titles = total([flag(folded.rlike(p)) for p in L.PREVIOUS_JOB_TITLES])
    return flag(
        any_of([found(folded, p) for p in L.PREVIOUS_JOB_PHRASES])
        | (F.size(F.array_distinct(spans)) >= 2)
        | (titles >= 2)
        | (count_of(folded, L.COMPANY_SUFFIXES) >= 2))


def promotion_keywords(folded: Column) -> Column:
    return contained(folded, L.PROMOTION_KEYWORDS)


# -------------------------------------------------------- intake signals

def contact_signals(folded: Column) -> Column:
    return F.struct(
        (folded.contains("@") & folded.rlike(L.EMAIL)).alias("email"),
        (folded.rlike(r"\d\d\d") & any_of(
            [folded.rlike(r"(?=[(\d])" + p if p.startswith(r"\(?\d") else at_word(p)) for p in L.PHONES])).alias("phone"),
        contains_any(folded, L.PROFILE_URLS).alias("url"))


def section_signals(folded: Column) -> Column:
    return F.struct(
        contains_any(folded, L.EDUCATION_HEADINGS).alias("education"),
        contains_any(folded, L.EXPERIENCE_HEADINGS).alias("experience"),
        contains_any(folded, L.SKILL_HEADINGS).alias("skills"))


def negative_hits(folded: Column) -> Column:
    return contained(folded, L.NEGATIVE_KEYWORDS)


def resume_likeness(folded: Column, n_entities: Column | None = None,
                    words: Column | None = None) -> Column:
    """Struct(score, is_resume): weighted intake signals, accepted from 45.

    ``n_entities`` may carry an entity count from an outside tagger (+20 above 5), ``words``
    the number of words when it is known.
    """
    contact, section = contact_signals(folded), section_signals(folded)

    def points(condition: Column, n: int) -> Column:
        return F.when(condition, F.lit(n)).otherwise(F.lit(0))

    score = total([
        points(contact.email, 25), points(contact.phone, 20), points(contact.url, 15),
        points(section.education, 10), points(section.experience, 10),
        points(section.skills, 10), negative_hits(folded) * F.lit(-30),
        points(words_per_line(folded, words) > 25, -25)])
    if n_entities is not None:
        score = score + points(n_entities > 5, 20)
    score = F.when(F.length(strip(folded)) < 50, F.lit(0)).otherwise(score)
    return let(score, lambda s: F.struct(s.alias("score"), (s >= 45).alias("is_resume")))


# ------------------------------------------------------- years in words

def required_years(folded: Column) -> Column:
    """First requirement between 1 and 50 years, patterns tried in order; else 0."""
    tries = []
    for pattern in L.REQUIRED_YEARS:
        n = F.regexp_extract(folded, pattern, 1).try_cast("double")
        tries.append(F.when(n.between(1, 50), n))
    return F.coalesce(*tries, F.lit(0.0))


def claimed_years(folded: Column) -> Column:
    """First 'N years of experience' claim, null when there is none."""
    return F.regexp_extract(folded, L.CLAIMED_YEARS, 1).try_cast("double")


# ------------------------------------------------------- reviewer replies

def parse_unit_score(reply: Column) -> Column:
    """First of 0.ddd, 1.0 or 0 in a reply; null when absent."""
    return F.regexp_extract(reply, r"(0\.\d+|1\.0|0)", 1).try_cast("double")


def parse_review(reply: Column) -> Column:
    """Struct(consensus, reasoning) from a JSON reply; null unless both are there."""
    parsed = F.from_json(reply, "consensus STRING, reasoning STRING")
    return F.when(parsed.consensus.isNotNull() & parsed.reasoning.isNotNull(), parsed)


def match_band(score: Column) -> Column:
    return F.when(score >= 0.70, "strong").when(score >= 0.35, "moderate").otherwise("weak")


def pseudonym(col: Column) -> Column:
    """Stable SHA-256 hex of a string."""
    return F.sha2(col.cast("string"), 256)
