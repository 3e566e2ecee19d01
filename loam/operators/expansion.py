"""Variants of a question by rules: patterns that rewrite what they capture, synonyms in
place, related words added, and words that stand for the asker.

The rules are tables; further synonyms, related words or names of persons are
parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values, all below: patterns with what becomes of the text they capture, ``{}``.
PATTERNS: list[tuple[str, str, list[str]]] = [
    ("preference", r"what (?:does|did) (\w+) (?:like|prefer|enjoy|love|want)", ["{} preferences", "{} favorites", "{} interests", "things {} enjoys", "{} hobbies", "what {} dislikes"]),
    ("about", r"tell me about (.+)", ["{} details", "{} information", "{} background", "{} overview", "who is {}", "what is {}"]),
    ("how", r"how (?:do|can|should|would) I (.+)", ["{} guide", "{} steps", "{} process", "{} instructions", "{} best practices"]),
    ("when", r"when (?:did|was|were|is) (.+)", ["{} date", "{} time", "{} timeline", "{} schedule"]),
    ("why", r"why (?:does|did|is|was|are|were) (.+)", ["{} reason", "{} cause", "{} explanation", "{} motivation"]),
    ("where", r"where (?:is|are|was|were|can I find) (.+)", ["{} location", "{} place", "find {}", "{} stored"]),
    ("happened", r"what happened (?:with|to|about|regarding) (.+)", ["{} events", "{} incident", "{} situation", "{} story", "{} update"]),
    ("remember", r"remember when (.+)", ["{}", "{} memory", "{} happened", "{} time"]),
    ("practices", r"(.+) best practices", ["{} guidelines", "{} recommendations", "{} tips", "{} advice", "{} lessons"]),
    ("problems", r"(?:problems?|issues?|troubles?) with (.+)", ["{} bugs", "{} errors", "{} failures", "{} difficulties", "fix {}"]),
    ("know", r"what do I know about (.+?)\??\z", ["{}", "{} details", "{} information", "{} facts"]),
    ("learn", r"(what) (?:did|have) I (?:learn|learned|discovered)", ["lessons learned", "insights", "discoveries", "realizations", "takeaways"]),
    ("who", r"who is (.+?)\??\z", ["{}", "about {}", "{} details", "{} information"]),
    ("what", r"what is (.+?)\??\z", ["{}", "{} definition", "{} explanation", "{} description"]),
]

#: A word and the two that may take its place.
SYNONYMS = """
like: prefer, enjoy; dislike: hate, avoid; prefer: like, favor; enjoy: like, love; love: adore, cherish; hate: despise, loathe; want: desire, wish;
learn: discover, realize; understand: comprehend, grasp; remember: recall, recollect; forget: overlook, miss; know: understand, realize;
do: perform, execute; make: create, build; use: utilize, employ; get: obtain, acquire; give: provide, supply; take: grab, seize; put: place, set;
go: travel, move; come: arrive, approach; start: begin, initiate; stop: end, finish; try: attempt, test; help: assist, support;
say: tell, mention; ask: inquire, question; tell: inform, notify; write: compose, draft; read: review, scan; talk: discuss, speak;
today: now, currently; yesterday: recently, the other day; tomorrow: upcoming, next day; soon: shortly, before long; later: afterward, subsequently;
before: prior to, earlier; after: following, subsequent to; always: constantly, continuously; never: not ever, at no time; often: frequently, regularly; sometimes: occasionally, now and then;
friend: buddy, companion; family: relatives, loved ones; child: kid, offspring; children: kids, offspring; parent: mom, dad; person: individual, someone; wife: spouse, partner; husband: spouse, partner;
project: task, work; meeting: call, sync; deploy: release, ship; build: create, develop; fix: repair, resolve; bug: issue, problem; feature: functionality, capability; test: verify, validate; code: program, software; work: job, task;
important: crucial, critical; urgent: pressing, immediate; good: great, excellent; bad: poor, terrible; best: optimal, ideal; worst: poorest, lowest;
many: numerous, several; few: some, a couple of; all: every, entire; none: no, zero; here: this place, this location; there: that place, that location; near: close to, nearby; far: distant, remote
"""
#: A word and the two that may be added to a question with it.
RELATED = """
like: preference, favorite; dislike: avoidance, aversion; work: job, career; health: fitness, wellness; food: meal, diet; travel: trip, vacation; money: finance, budget; home: house, apartment;
family: relatives, children; friend: friendship, relationship; learn: education, study; memory: remember, recall; future: plan, goal; code: programming, development; deploy: release, production;
meeting: call, sync; project: initiative, effort; problem: issue, challenge; solution: fix, answer; idea: thought, concept; decision: choice, determination; lesson: insight, learning
"""
#: Letters that are found anywhere in a question, and what takes the place of each.
PERSONS = {"i": "user", "my": "user", "me": "user"}
MOST_VARIANTS, FEWER_VARIANTS = 7, 3


def listed(text: str) -> dict[str, list[str]]:
    """``word: one, two; ...`` as a table."""
    pairs = (entry.split(":") for entry in text.replace("\n", " ").split(";") if entry.strip())
    return {word.strip(): [x.strip() for x in others.split(",")][:2] for word, others in pairs}


def _captured(text: Column, pattern: str) -> Column:
    found = F.regexp_replace(F.regexp_extract(text, f"(?i){pattern}", 1), r"^\s+|\s+\z", "")
    return F.regexp_replace(found, r"\?+\z", "") if pattern.endswith(r"\??\z") else found


def _by_word(text: Column, table: dict[str, list[str]], make) -> Column:
    """``make`` of each word of the text that is in the table and each of its others."""
    known = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in table.items() for x in kv])
    words = F.filter(F.split(F.lower(text), r"\s+", -1), lambda w: w.isin(list(table)))
    return F.flatten(F.transform(words, lambda w: F.transform(F.element_at(known, w), lambda other: make(w, other))))


def _bag(variant: Column) -> Column:
    """A variant's words in order of the alphabet, without marks."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(variant), r"[^A-Za-z0-9_\s]", ""), r"\s+", " ")
    return F.array_join(F.array_sort(F.split(F.trim(plain), " ", -1)), " ")


def expand_queries(
    queries: DataFrame,
    most: int = MOST_VARIANTS,
    synonyms: dict[str, list[str]] | None = None,
    related: dict[str, list[str]] | None = None,
    persons: dict[str, str] | None = None,
) -> DataFrame:
    """``(item_id, position, variant, source)``: the question at position 0, then what
    patterns, synonyms, related words and persons make of it, in this order.

    The first ``most`` different variants are kept (a plan for little time asks for
    FEWER_VARIANTS), and of those with the same words in any order the first.  A null text
    is empty.
    """
    text = F.coalesce("text", F.lit(""))
    parts = [F.array(text)]
    for _, pattern, makes in PATTERNS:
        own = _captured(text, pattern)
        made = F.array(*[F.concat(*[own if k % 2 else F.lit(x) for k, x in enumerate(m.replace("{}", "\0{}\0").split("\0")) if x]) for m in makes])
        parts.append(F.when(text.rlike(f"(?i){pattern}"), made).otherwise(F.array().cast("array<string>")))
    parts.append(_by_word(text, synonyms or listed(SYNONYMS), lambda w, other: F.regexp_replace(text, F.concat(F.lit("(?i)(?<![A-Za-z0-9_])"), w, F.lit("(?![A-Za-z0-9_])")), other)))
    parts.append(_by_word(text, related or listed(RELATED), lambda w, other: F.concat_ws(" ", text, other)))
    for name, other in (persons or PERSONS).items():
        parts.append(F.when(F.contains(F.lower(text), F.lit(name)), F.array(F.regexp_replace(text, f"(?i){name}", other))).otherwise(F.array().cast("array<string>")))
    first = queries.select("item_id", F.slice(F.array_distinct(F.concat(*parts)), 1, most).alias("v"))
    bags = first.withColumn("bags", F.transform("v", _bag))
    kept = bags.select("item_id", F.filter("v", lambda _, i: F.array_position("bags", F.get("bags", i)) == i + 1).alias("v"))
    each = kept.select("item_id", F.posexplode("v").alias("position", "variant"))
    return each.withColumn("source", F.when(F.col("position") == 0, "original").otherwise("rules"))


def expansion_sql(most: int = MOST_VARIANTS) -> str:
    """Oracle form: CTEs that end in ``variants (item_id, position, variant)`` of
    ``asked (item_id, text)``."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def rule(pattern, makes):
        own = rf"regexp_replace(regexp_extract(t, {quoted('(?i)' + pattern)}, 1), '^\s+|\s+\z', '', 'g')"
        own = rf"regexp_replace({own}, '\?+\z', '')" if pattern.endswith(r"\??\z") else own
        made = ", ".join(" || ".join("c" if x == "{}" else quoted(x) for x in m.replace("{}", "\0{}\0").split("\0") if x) for m in makes)
        return rf"CASE WHEN regexp_matches(t, {quoted('(?i)' + pattern)}) THEN list_transform([{own}], lambda c: [{made}])[1] ELSE [] END"

    def by_word(table, made):
        names, others = ", ".join(map(quoted, table)), ", ".join("[" + ", ".join(map(quoted, x)) + "]" for x in table.values())
        words = rf"list_filter(regexp_split_to_array(lower(t), '\s+'), lambda w: list_contains([{names}], w))"
        return rf"flatten(list_transform({words}, lambda w: list_transform([{others}][list_position([{names}], w)], lambda o: {made})))"

    persons = [f"CASE WHEN contains(lower(t), {quoted(n)}) THEN [regexp_replace(t, {quoted('(?i)' + n)}, {quoted(o)}, 'g')] ELSE [] END" for n, o in PERSONS.items()]
    parts = ["[t]", *[rule(p, m) for _, p, m in PATTERNS], by_word(listed(SYNONYMS), r"regexp_replace(t, '(?i)\b' || w || '\b', o, 'g')"), by_word(listed(RELATED), "t || ' ' || o"), *persons]
    every = parts[0]
    for p in parts[1:]:
        every = f"list_concat({every}, {p})"
    return rf"""all_variants AS (SELECT item_id, {every} AS v FROM (SELECT item_id, coalesce(text, '') AS t FROM asked)),
first_variants AS (SELECT item_id, list_filter(v, lambda x, i: list_position(v, x) = i)[1:{most}] AS v FROM all_variants),
bags AS (SELECT item_id, v, list_transform(v, lambda x: array_to_string(list_sort(string_split(trim(regexp_replace(regexp_replace(lower(x), '[^A-Za-z0-9_\s]', '', 'g'), '\s+', ' ', 'g')), ' ')), ' ')) AS b FROM first_variants),
kept AS (SELECT item_id, list_filter(v, lambda x, i: list_position(b, b[i]) = i) AS v FROM bags),
variants AS (SELECT item_id, unnest(range(0, len(v)))::INT AS position, unnest(v) AS variant FROM kept)"""
