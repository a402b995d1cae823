"""Dictionary terms as regular expressions, for dictionaries of bounded size.

A ``TermSet`` turns a list of terms into one alternation, so a text is scanned
once instead of once per term and nothing is shuffled.  It is for word lists the
program holds anyway; ``operators.matching.match_terms`` joins dictionaries of
any size.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier import lexicon as L
from dossier.functions.numeric import let
from dossier.functions.text import constant

_META = set(r".^$*+?{}[]\|()")


def escape(term: str) -> str:
    return "".join("\\" + ch if ch in _META else ch for ch in term)


def _is_word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def edges(term: str, literal: bool = False) -> tuple[str, str]:
    """Boundary assertions around a term.

    A term that starts or ends in a non-word character needs a non-word
    neighbour (``\\B``), else 'C++' could never match.  ``literal`` gives the plain
    ``\\b`` on both sides.
    """
    if literal:
        return r"\b", r"\b"
    return (r"\b" if _is_word(term[0]) else r"\B",
            r"\b" if _is_word(term[-1]) else r"\B")


def term_pattern(term: str, literal: bool = False) -> str:
    left, right = edges(term, literal)
    return left + escape(term.lower()) + right


def alternation(terms, literal: bool = False) -> str:
    """One pattern for all terms, longest first, grouped by first character."""
    groups = defaultdict(list)
    for term in sorted({t.lower() for t in terms}, key=lambda t: (-len(t), t)):
        groups[(edges(term, literal)[0], term[0])].append(term)
    by_edge = defaultdict(list)
    for (left, first), members in sorted(groups.items()):
        rest = "|".join(escape(m[1:]) + edges(m, literal)[1] for m in members)
        by_edge[left].append(f"{escape(first)}(?:{rest})")
    return "|".join(f"{left}(?:{'|'.join(parts)})" for left, parts in by_edge.items())


AT_EDGE = "(?<![a-z0-9_])"     # every boundary of ``edges`` lies here; far cheaper to test first


class TermSet:
    """Named terms that are searched together.

    ``names`` maps a lower-cased term to the name reported for it.
    """

    def __init__(self, terms, literal: bool = False):
        self.names = {t.lower(): t for t in reversed(list(terms))}
        self.literal = literal

    def _names_at(self, term: str) -> list[str]:
        """Names of all terms that match wherever ``term`` matches."""
        out = set()
        for other, name in self.names.items():
            if not term.startswith(other):
                continue
            right, rest = edges(other, self.literal)[1], term[len(other):]
            changes = rest != "" and _is_word(rest[0]) != _is_word(other[-1])
            if rest == "" or changes == (right == r"\b"):
                out.add(name)
        return sorted(out)

    def hits(self, folded: Column) -> Column:
        """Sorted distinct names found, overlapping terms all kept.

        A zero-width look-ahead captures the longest term at every position; the
        shorter ones that start there are its prefixes, known in advance.
        """
        edge = "" if self.literal or not "".join(self.names).isascii() else AT_EDGE
        found = F.array_distinct(F.regexp_extract_all(
            folded, F.lit(f"{edge}(?=({alternation(self.names, self.literal)}))")))
        names = constant({t: self._names_at(t) for t in self.names}, "map<string,array<string>>")
        return F.array_sort(F.array_distinct(F.flatten(
            F.transform(found, lambda h: F.element_at(names, h)))))

    def count(self, folded: Column) -> Column:
        """Number of distinct terms present."""
        return F.size(self.hits(folded))


def _alias_map() -> Column:
    return constant(L.ALIASES, "map<string,string>")


def canonical_skill(token: Column) -> Column:
    """Canonical name of one token, else the token itself."""
    key = F.lower(F.btrim(token, F.lit(" \t\n\r\f\x0b")))
    return F.coalesce(F.try_element_at(_alias_map(), key), token)


def alias_hits(folded: Column) -> Column:
    """Aliases found in one left-to-right pass, longest first, in text order."""
    return F.regexp_extract_all(folded, F.lit(f"{AT_EDGE}({alternation(L.ALIASES)})"))


_MARK = "\ue000"  # private-use character that fences alias hits


def _cascaded(text: Column) -> Column:
    """The aliases one after the other, longest first; a pattern is searched only where the
    alias occurs as a substring of the lower-cased text so far."""
    rows = []
    for alias in sorted(L.ALIASES, key=len, reverse=True):
        before, after = (r"(?<![a-z0-9])", r"(?![a-z0-9])") if " " in alias else (r"\b", r"\b")
        rows.append({"part": alias, "pattern": f"(?i){before}{escape(alias)}{after}",
                     "name": L.ALIASES[alias]})
    table = constant(rows, "array<struct<part:string,pattern:string,name:string>>")

    def state(t: Column) -> Column:
        return let(t, lambda v: F.struct(v.alias("text"), F.lower(v).alias("low")))

    return F.aggregate(
        table, state(text),
        lambda so_far, x: F.when(F.contains(so_far.low, x.part), state(
            F.regexp_replace(so_far.text, x.pattern, x["name"]))).otherwise(so_far),
        lambda so_far: so_far.text)


def normalize_aliases(text: Column, cascade: bool = False, lowered: bool = False) -> Column:
    """Replace aliases by canonical names.

    Default: one pass, every stretch of text is replaced at most once.  With
    ``cascade`` the aliases are applied one after the other, longest first, each
    on the output of the one before, so a replacement may be replaced again.
    ``lowered`` says that the text is lower-case already.
    """
    if cascade:
        return _cascaded(text)
    pattern = ("" if lowered else "(?i)") + AT_EDGE + "(" + alternation(L.ALIASES) + ")"

    def name(hit: Column) -> Column:
        return F.element_at(_alias_map(), hit if lowered else F.lower(hit))

    # one scan fences the hits, so the odd parts between the marks are aliases
    fenced = F.split(F.regexp_replace(text, pattern, f"{_MARK}$1{_MARK}"), _MARK)
    one_scan = F.transform(fenced, lambda part, i: F.when(i % 2 == 1, name(part)).otherwise(part))
    # a text that holds the mark itself is cut at the hits instead
    two_scans = F.zip_with(
        F.split(text, pattern),
        F.transform(F.regexp_extract_all(text, F.lit(pattern)), name),
        lambda part, n: F.concat(part, F.coalesce(n, F.lit(""))))
    return F.array_join(F.when(text.contains(_MARK), two_scans).otherwise(one_scan), "")


def extract_skills(folded: Column, skills: TermSet) -> Column:
    """Sorted distinct skill names in a text, aliases resolved first."""
    return skills.hits(F.lower(normalize_aliases(folded, lowered=True)))
