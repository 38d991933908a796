"""Rule-based extraction of activities, hazards, barrier failures and more from report text.

Rules are a bounded list known when the plan is built.  One automaton over all
their literals, built once per task, passes over each text once and gives the
places of hazard phrases and the literals that are there.  The rest are SQL
expressions over that short list: a pattern is tried only on texts that hold its
longest literal piece, and words before a hazard phrase are looked at only where
it was hit.  No rule is joined to a report and no row is multiplied.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incident_signals import fixed_values as fixed
from incident_signals.functions.text import WORD_END, WORD_START, title_case_sql

# The search for literals runs inside tasks; it travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HIGH, MEDIUM, LOW = "HIGH", "MEDIUM", "LOW"
ENTITY_COLUMNS = ["activities", "equipment", "hazards", "barrier_failures", "unsafe_actions", "unsafe_conditions",
                  "potential_consequences"]
_TEXT, _LOWER, _LITERALS = "_text", "_lower", "_literals"
# texts that match only themselves
_LITERAL = r"[a-z0-9 '&/-]+"
_NO_STRINGS = "CAST(array() AS ARRAY<STRING>)"


@dataclass(frozen=True)
class Rule:
    """One pattern for a value.  ``word`` demands word boundaries around the match."""

    value: str
    pattern: str
    confidence: str = HIGH
    word: bool = False

    @property
    def regex(self) -> str:
        if not self.word:
            return f"(?id){self.pattern}"
        return f"(?id){whole_word(self.pattern)}"

    @property
    def literal(self) -> bool:
        return bool(re.fullmatch(_LITERAL, self.pattern))

    @property
    def needle(self) -> str:
        """Longest text every match contains, lower case; empty if there is none."""
        if "|" in re.sub(r"\(\?:[^)]*\)", "", self.pattern):
            return ""
        pieces = re.split(r"\(\?:[^)]*\)[?*+]?|\\[a-zA-Z][?*+]?|\[[^\]]*\][?*+]?|\.[?*+]?|.[?*]|\{[^}]*\}", self.pattern)
        return max((p for p in pieces if not re.search(r"[\\^$()+]", p)), key=len, default="").lower()


def whole_word(pattern: str) -> str:
    """The pattern between word boundaries.

    For a literal the front boundary is tested after it, by its known length:
    the search then skips from first letter to first letter.
    """
    if re.fullmatch(_LITERAL, pattern):
        return rf"{pattern}{WORD_END}(?<![\p{{L}}\p{{N}}_].{{{len(pattern)}}})"
    return f"{WORD_START}{pattern}{WORD_END}"


def rules_of(block: str, confidence=lambda pattern: HIGH, word: bool = False) -> list[Rule]:
    return [Rule(value, p, confidence(p), word) for value, patterns in fixed.table(block) for p in patterns]


ACTIVITY_RULES = rules_of(fixed.ACTIVITY_RULES, lambda p: HIGH if len(p) > 8 else MEDIUM, word=True)
ACTION_RULES = rules_of(fixed.UNSAFE_ACTION_RULES)
CONDITION_RULES = rules_of(fixed.UNSAFE_CONDITION_RULES)
# a category's own phrases come before its extensions
BARRIER_RULES = [
    rule
    for category, _ in fixed.table(fixed.BARRIER_PHRASES)
    for block in (fixed.BARRIER_PHRASES, fixed.BARRIER_EXTENSIONS)
    for rule in rules_of(block)
    if rule.value == category
]
CONSEQUENCE_RULES = rules_of(fixed.CONSEQUENCE_NAMES, word=True)


def _lit(text: str) -> str:
    """Raw SQL string literal."""
    if '"' in text:
        raise ValueError(f"patterns must not contain double quotes: {text}")
    return f'r"{text}"'


def _in_word(char: str) -> bool:
    return char == "_" or unicodedata.category(char)[0] in "LN"


def literals(lower: Column, phrases: list[tuple[str, bool]], needed: list[list[str]]) -> Column:
    """What one pass finds: ``hits`` (phrase by its place in the list, first character from 0), by phrase and
    character, and ``present``, the places in ``needed`` of which a text is there or that need none, in order.

    Phrases come with whether they hit as whole words only.
    """
    wanted: dict[str, tuple[list[tuple[int, bool]], list[int]]] = {}
    for place, (text, whole) in enumerate(phrases):
        wanted.setdefault(text, ([], []))[0].append((place, whole))
    for place, texts in enumerate(needed):
        for text in texts:
            wanted.setdefault(text, ([], []))[1].append(place)
    always = [place for place, texts in enumerate(needed) if not texts]

    @F.arrow_udf("struct<hits:array<struct<rule:int,at:int>>,present:array<int>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for text, (own, needing) in wanted.items():
            automaton.add_word(text, (len(text), own, needing))
        if wanted:
            automaton.make_automaton()
        for texts in batches:
            rules, places, hits, present, held = [], [], [0], [], [0]
            for text in texts.to_pylist():
                seen, found = set(always), []
                for end, (size, own, needing) in automaton.iter(text or "") if wanted else ():
                    at = end - size + 1
                    for rule, whole in own:
                        if not whole or not (at and _in_word(text[at - 1]) or _in_word(text[end + 1 : end + 2] or " ")):
                            found.append((rule, at))
                    seen.update(needing)
                for rule, at in sorted(found):
                    rules.append(rule)
                    places.append(at)
                present.extend(sorted(seen))
                hits.append(len(rules))
                held.append(len(present))
            hit = pa.StructArray.from_arrays([pa.array(rules, pa.int32()), pa.array(places, pa.int32())], ["rule", "at"])
            yield pa.StructArray.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array(hits, pa.int32()), hit),
                    pa.ListArray.from_arrays(pa.array(held, pa.int32()), pa.array(present, pa.int32())),
                ],
                ["hits", "present"],
            )

    return find(lower)


def _contains_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_lit(word)})" for word in words) + ")"


def _of(place: str, values: list) -> str:
    """The value at a place of a list known at planning."""
    return f"array({', '.join(_lit(v) if isinstance(v, str) else str(v).lower() for v in values)})[{place}]"


def _by_preference(rules: list[Rule]) -> list[Rule]:
    """By value in order of first rules, then high before medium confidence, then rule order."""
    values = list(dict.fromkeys(rule.value for rule in rules))
    return sorted(
        (rule for rule in rules if rule.confidence in (HIGH, MEDIUM)),
        key=lambda rule: (values.index(rule.value), rule.confidence != HIGH),
    )


def _phrases(rules: list[Rule]) -> list[tuple[str, bool]]:
    return [(rule.pattern, rule.word) for rule in rules if rule.literal]


def _needed(rules: list[Rule]) -> list[list[str]]:
    return [[rule.needle] if rule.needle else [] for rule in rules if not rule.literal]


def _places(low: int, high: int) -> str:
    return f"filter({_LITERALS}.present, r -> r >= {low} AND r < {high})"


def _matched(rules: list[Rule], first: int) -> Column:
    """Evidence by the rules, in their order: literal ones where they hit, patterns where a literal of theirs is.

    The hits of literal rules have places from ``first``; patterns come first in ``needed``.
    """
    said, tried = [i for i, rule in enumerate(rules) if rule.literal], [i for i, rule in enumerate(rules) if not rule.literal]
    parts = []
    if said:
        size = [len(rules[i].pattern) for i in said]
        hits = f"filter({_LITERALS}.hits, h -> h.rule >= {first} AND h.rule < {first + len(said)})"
        evidence = f"substr({_TEXT}, h.at + 1, {_of(f'h.rule - {first}', size)})"
        found = f"transform({hits}, h -> named_struct('rule', {_of(f'h.rule - {first}', said)}, 'at', h.at, 'evidence', {evidence}))"
        # upper case is that of ASCII; a letter beyond it has more bytes
        parts.append(f"filter({found}, m -> octet_length(m.evidence) = length(m.evidence))")
    if tried:
        evidence = f"regexp_extract({_TEXT}, {_of('r', [rules[i].regex for i in tried])}, 0)"
        found = f"transform({_places(0, len(tried))}, r -> named_struct('rule', {_of('r', tried)}, 'at', 0, 'evidence', {evidence}))"
        parts.append(f"filter({found}, m -> m.evidence != '')")
    if not parts:
        return F.expr("CAST(array() AS ARRAY<STRUCT<rule:INT,at:INT,evidence:STRING>>)")
    return F.expr(f"sort_array(concat({', '.join(parts)}))" if len(parts) > 1 else f"sort_array({parts[0]})")


def _first_of(found: str, names: list) -> Column:
    """The first of each run of places with the same name."""
    if not names:
        return F.col(found)
    ids = {name: i for i, name in enumerate(dict.fromkeys(names))}
    codes = [ids[name] for name in names]
    return F.expr(f"filter({found}, (m, i) -> i = 0 OR {_of('m.rule', codes)} != {_of(f'get({found}, i - 1).rule', codes)})")


def _items(best: str, rules: list[Rule], low: int, high: int) -> Column:
    """Extraction items of the rules from place ``low`` up to ``high``."""
    if low == high:
        return F.expr("CAST(array() AS ARRAY<STRUCT<value:STRING,evidence:STRING,confidence:STRING,match_method:STRING>>)")
    return F.expr(
        f"""transform(filter({best}, m -> m.rule >= {low} AND m.rule < {high}),
              m -> named_struct('value', {_of('m.rule', [rule.value for rule in rules])}, 'evidence', m.evidence,
                                'confidence', {_of('m.rule', [rule.confidence for rule in rules])}, 'match_method', 'regex'))"""
    )


def _prepared(df: DataFrame, text: str, phrases: list[tuple[str, bool]], needed: list[list[str]]) -> DataFrame:
    plain = F.coalesce(F.col(text), F.lit(""))
    # the one letter whose lower case is longer, so that places in both agree
    lower = F.lower(F.replace(plain, F.lit("\u0130"), F.lit("I")))
    return df.withColumns({_TEXT: plain, _LOWER: lower}).withColumn(_LITERALS, literals(F.col(_LOWER), phrases, needed))


def settled_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The same rows, with the named columns as the output of a generator.

    A filter on them is not moved below the extraction, which would copy the
    whole extraction into its condition; a filter on any other column is.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(*others, F.inline(F.array(F.struct(*names)))).select(*[F.col(f"`{c}`") for c in df.columns])


def match_rules(df: DataFrame, text: str, rules: list[Rule], output: str) -> DataFrame:
    """Adds an array of extraction items: per value the best evidence, in rule order."""
    ranked = _by_preference(rules)
    staged = _prepared(df, text, _phrases(ranked), _needed(ranked)).withColumn("_matches", _matched(ranked, 0))
    best = staged.withColumn("_best", _first_of("_matches", [rule.value for rule in ranked]))
    named = best.withColumn(output, _items("_best", ranked, 0, len(ranked)))
    return settled_columns(named.drop(_TEXT, _LOWER, _LITERALS, "_matches", "_best"), [output])


# --- hazards ------------------------------------------------------------------------------

_NEGATED = rf"\b(?:{'|'.join(fixed.NEGATORS)})\b\s*(?:[^\s.,;]+)?\s*$"
_NOT_OR_FAILED = r"\b(?:not|failed to)\b"


# by category, its long phrases, which give high confidence, before the others
HAZARDS = [
    (rule.value, rule.pattern) for rule in _by_preference(rules_of(fixed.HAZARD_PHRASES, lambda p: HIGH if len(p) > 6 else MEDIUM))
]


def _of_rule(values: list) -> str:
    """The value of a hit's phrase."""
    return _of("h.rule", values)


def _clear_hits() -> Column:
    """Hits of hazard phrases that are not denied and not in an excluded context."""
    size, context, near_size = fixed.LONG_NEGATION_WINDOW, fixed.FIRE_CONTEXT, fixed.NEGATION_WINDOW
    length = _of_rule([len(p) for _, p in HAZARDS])
    far = f"substr({_LOWER}, greatest(h.at - {size}, 0) + 1, least(h.at, {size}))"
    after = f"substr({_LOWER}, h.at + {length} + 1, {context})"
    energy = _of_rule([c in fixed.ENERGY_CATEGORIES for c, _ in HAZARDS])
    denied = f"rlike(h.near, {_lit(_NEGATED)}) OR ({energy} AND {_contains_any('h.near', fixed.ENERGY_CLEAR)})"
    twice = _of_rule(["depressurized" in p for _, p in HAZARDS])
    denied = f"({denied}) AND NOT ({twice} AND rlike(h.near, {_lit(_NOT_OR_FAILED)}))"
    fire_line = _of_rule([c == "Line-of-fire exposure" for c, _ in HAZARDS])
    aside = f"{_contains_any('h.far', fixed.LINE_OF_FIRE_CLEAR)} OR contains(h.near, 'nobody')"
    fire = _of_rule([c == "Fire/explosion" and "fire" in p for c, p in HAZARDS])
    around = f"concat(right(h.far, {near_size}), substr({_LOWER}, h.at + 1, {length}), h.after)"
    guards = dict(fixed.table(fixed.HAZARD_GUARDS))
    guarded = _of_rule([list(guards).index(c) if c in guards else -1 for c, _ in HAZARDS])
    needed = " ".join(f"WHEN {i} THEN {_contains_any(_LOWER, words)}" for i, words in enumerate(guards.values()))
    windows = f"transform(filter({_LITERALS}.hits, h -> h.rule < {len(HAZARDS)}), h -> named_struct('rule', h.rule, 'at', h.at, 'far', {far}, 'after', {after}))"
    with_near = f"transform({windows}, h -> named_struct('rule', h.rule, 'at', h.at, 'far', h.far, 'after', h.after, 'near', btrim(right(h.far, {near_size}))))"
    return F.expr(
        f"""transform(filter({with_near}, h -> NOT ({denied}) AND NOT ({fire_line} AND ({aside}))
              AND NOT ({fire} AND {_contains_any(around, fixed.FIRE_EXCLUDED_CONTEXTS)})
              AND CASE {guarded} {needed} ELSE true END), h -> named_struct('rule', h.rule, 'at', h.at))"""
    )


def _hazard_items(best: str) -> Column:
    """Items of the first hit of each category."""
    confidence = _of_rule([HIGH if len(p) > 6 else MEDIUM for _, p in HAZARDS])
    return F.expr(
        f"""transform({best}, h -> named_struct('value', {_of_rule([c for c, _ in HAZARDS])},
              'evidence', substr({_TEXT}, h.at + 1, {_of_rule([len(p) for _, p in HAZARDS])}),
              'confidence', {confidence}, 'match_method', 'regex'))"""
    )


# --- equipment ----------------------------------------------------------------------------


_TAGGED = "|".join(fixed.TAGGED_EQUIPMENT)
_TAGS = [rf"\b(?:{_TAGGED})\s+[A-Z0-9-]+\b", rf"\b[A-Z0-9-]++\s++(?:{_TAGGED})\b"]
# pattern, and the texts of which one is in every match
EQUIPMENT = [(f"(?iU){tag}", fixed.TAGGED_EQUIPMENT) for tag in _TAGS] + [
    (rf"(?iU)\b{word}\b", [word]) for word in fixed.EQUIPMENT_WORDS
]


def _equipment_mentions(first: int, hit: int) -> Column:
    """Mentions by the equipment patterns, whose places in ``needed`` begin at ``first``; the words' hits begin at ``hit``.

    In a text of ASCII alone the hits are the words' matches, and letters, digits and spaces need no tables of Unicode.
    """
    pattern = _of(f"r - {first}", [regex for regex, _ in EQUIPMENT])
    places = _places(first, first + len(EQUIPMENT))
    searched = f"flatten(transform({places}, r -> regexp_extract_all({_TEXT}, {pattern}, 0)))"
    size = _of(f"h.rule - {hit}", [len(word) for word in fixed.EQUIPMENT_WORDS])
    words = f"transform(filter({_LITERALS}.hits, h -> h.rule >= {hit}), h -> substr({_TEXT}, h.at + 1, {size}))"
    tagged = ", ".join(f"regexp_extract_all({_TEXT}, {_lit(f'(?i){tag}')}, 0)" for tag in _TAGS)
    plain = f"if(array_contains({_LITERALS}.present, {first}), concat({tagged}, {words}), {words})"
    found = f"if(octet_length({_TEXT}) = length({_TEXT}), {plain}, {searched})"
    return F.expr(f"transform({found}, m -> named_struct('mention', m, 'low', lower(m)))")


def _maximal(mentions: str) -> Column:
    """Mentions not contained in a longer one, each once."""
    return F.expr(
        f"""filter({mentions}, (m, i) -> NOT exists({mentions}, o -> length(o.low) > length(m.low) AND contains(o.low, m.low))
              AND array_position({mentions}.low, m.low) = i + 1)"""
    )


def _equipment_items(mentions: str) -> Column:
    branches = " ".join(
        f"WHEN {_contains_any('m.low', words)} THEN {_lit(kind)}" for kind, words in fixed.table(fixed.EQUIPMENT_TYPES)
    )
    titled = f"transform({mentions}, m -> named_struct('mention', m.mention, 'low', m.low, 'title', {title_case_sql('m.mention')}))"
    return F.expr(
        f"""transform({titled}, m -> named_struct('value', m.title, 'type', CASE {branches} ELSE m.title END,
              'evidence', m.mention, 'confidence', '{HIGH}', 'match_method', 'regex'))"""
    )


# --- derived entities ---------------------------------------------------------------------


def _first_per_value(items: str) -> Column:
    return F.expr(f"filter({items}, (x, i) -> array_position({items}.value, x.value) = i + 1)")


def _inferred_consequences(hazards: str) -> Column:
    """Consequences that follow from hazards, with the hazard's evidence."""
    branches = " ".join(
        f"WHEN {_lit(hazard.lower())} THEN array({', '.join(map(_lit, consequences))})"
        for hazard, consequences in fixed.table(fixed.HAZARD_CONSEQUENCES)
    )
    return F.expr(
        f"""flatten(transform({hazards}, h -> transform(CASE lower(h.value) {branches} ELSE {_NO_STRINGS} END,
              c -> named_struct('value', c, 'evidence', h.evidence, 'confidence', '{MEDIUM}', 'match_method', 'synonym'))))"""
    )


def precursor_tags(hazards: str, barriers: str, conditions: str) -> Column:
    """Sorted distinct tags; the arguments name arrays of extraction items."""

    def tags(items: str, block: str, condition: str) -> list[str]:
        return [
            f"if(exists({items}, x -> {condition.format(key=_lit(key))}), {_lit(tag)}, NULL)"
            for key, tag in fixed.pairs(block)
        ]

    found = (
        tags(hazards, fixed.HAZARD_TAGS, "contains(lower(x.value), {key})")
        + tags(barriers, fixed.BARRIER_TAGS, "x.value = {key}")
        + tags(conditions, fixed.CONDITION_TAGS, "contains(lower(x.value), {key})")
    )
    return F.expr(f"array_sort(array_distinct(filter(array({', '.join(found)}), t -> t IS NOT NULL)))")


def extract(df: DataFrame, text: str = "description", only: list[str] | None = None) -> DataFrame:
    """Adds the seven entity arrays and ``precursor_tags``; no shuffle, one pass over the text.

    With ``only``, those of them that are named, and the work for the others is left out.
    """
    users = {
        "activities": (ACTIVITY_RULES, ["activities"]),
        "barrier_failures": (BARRIER_RULES, ["barrier_failures", "precursor_tags"]),
        "unsafe_actions": (ACTION_RULES, ["unsafe_actions"]),
        "unsafe_conditions": (CONDITION_RULES, ["unsafe_conditions", "precursor_tags"]),
        "potential_consequences": (CONSEQUENCE_RULES, ["potential_consequences"]),
    }
    # all rules in one list, a stretch for each column; equipment patterns after them
    ranked, codes, stretch = [], [], {}
    for name, (rules, used) in users.items():
        sought = _by_preference(rules) if only is None or set(used) & set(only) else []
        stretch[name] = (len(ranked), len(ranked) + len(sought))
        ranked += sought
        codes += [(name, rule.value) for rule in sought]
    with_equipment = only is None or "equipment" in only
    with_hazards = only is None or bool({"hazards", "potential_consequences", "precursor_tags"} & set(only))
    hazards = [(phrase, True) for _, phrase in HAZARDS] if with_hazards else []
    phrases = hazards + _phrases(ranked)
    words = [(word, True) for word in fixed.EQUIPMENT_WORDS] if with_equipment else []
    needed = _needed(ranked) + ([words for _, words in EQUIPMENT] if with_equipment else [])
    named = (
        _prepared(df, text, phrases + words, needed)
        .withColumns(
            {
                "_hits": _clear_hits() if with_hazards else F.expr("CAST(array() AS ARRAY<STRUCT<rule:INT,at:INT>>)"),
                "_matches": _matched(ranked, len(hazards)),
                "_mentions": _equipment_mentions(len(_needed(ranked)), len(phrases)),
            }
        )
        .withColumns({"_hazards": _first_of("_hits", [c for c, _ in HAZARDS]), "_best": _first_of("_matches", codes)})
        .withColumns({name: _items("_best", ranked, *ends) for name, ends in stretch.items()})
        .withColumns({"hazards": _hazard_items("_hazards"), "equipment": _maximal("_mentions")})
        .withColumn("equipment", _equipment_items("equipment"))
    )
    done = with_derived(named.drop(_TEXT, _LOWER, _LITERALS, "_hits", "_hazards", "_matches", "_best", "_mentions"))
    every = [*ENTITY_COLUMNS, "precursor_tags"]
    wanted = [c for c in every if only is None or c in only]
    return settled_columns(done.drop(*[c for c in every if c not in wanted]), wanted)


def with_derived(df: DataFrame) -> DataFrame:
    """Consequences inferred from hazards, and tags, added to the entities found so far."""
    joined = df.withColumn(
        "potential_consequences", F.concat("potential_consequences", _inferred_consequences("hazards"))
    )
    return joined.withColumns(
        {
            "potential_consequences": _first_per_value("potential_consequences"),
            "precursor_tags": precursor_tags("hazards", "barrier_failures", "unsafe_conditions"),
        }
    )


def long_entities(extracted: DataFrame, columns: list[str] = ENTITY_COLUMNS, key: str = "report_id") -> DataFrame:
    """One row per extracted item: key, category, value, evidence, confidence, match_method."""
    tagged = [
        f"""transform({name}, x -> named_struct('category', '{name}', 'value', x.value, 'evidence', x.evidence,
              'confidence', x.confidence, 'match_method', x.match_method))"""
        for name in columns
    ]
    return extracted.select(key, F.inline(F.expr(f"concat({', '.join(tagged)})")))
