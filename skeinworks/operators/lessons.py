"""Lessons of agent sessions: extraction, near-duplicates against known ones, retention."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from skeinworks.session import spread, stored

#: Lessons that a playbook keeps, and the cosine above which a lesson is known already.
KEPT, SIMILAR = 120, 0.82
#: Terms of a side, up to which its rows (some 30 bytes each) are broadcast.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Family:
    """Lessons of one kind: where they match, and how groups make the text."""

    kind: str
    pattern: str
    template: str
    confidence: float
    least: int = 0
    not_holding: tuple[str, ...] = ()


#: The six families in their order; {1} is a pattern's first group, TOOL the tool
#: that `families` names.
_FAMILIES = (
    Family("file-location", r"(?i)(?:found|located|implemented|defined)\s+in\s+([\w/.@-]+\.(?:ts|js|tsx|jsx))", "File location: {1}", 0.7),
    Family("meteor-method", r"Meteor\.(?:call|methods)\s*\(\s*['\"]([^'\"]+)['\"]", "Meteor method '{1}' discovered in session", 0.85),
    Family("alias", r"(?i)@([\w./-]+)\s*(?:→|->|resolves to|is at)\s*([\w/.@-]+)", "Import alias @{1} resolves to {2}", 0.9),
    Family("convention", r"(?i)(?:I (?:learned|discovered|found) that|The pattern (?:is|for)|Always use|Convention:|Note:)\s+([^.!?\n]{20,150}[.!?])", "{1}", 0.75, 21, ("{", "function")),
    Family("avoid", r"(?i)(?:no results|not found|failed to find)\s+(?:for\s+)?['\"]?([^'\".\n]{5,80})['\"]?", "Search term '{1}' yielded no results — use TOOL instead", 0.6, 5),
    Family("module", r"(?i)(?:package|module)\s+['\"]?([\w@/-]+)['\"]?\s+(?:exports|provides|contains)\s+([^.\n]{10,100})", "Package {1} provides: {2}", 0.8),
)


def families(tool: str = "search_symbol") -> tuple[Family, ...]:
    """The six families, the lesson on failed searches naming this tool."""
    return tuple(replace(f, template=f.template.replace("TOOL", tool)) for f in _FAMILIES)


FAMILIES = families()


def extract(texts: DataFrame, key: str, text: str, families: tuple[Family, ...] = FAMILIES) -> DataFrame:
    """key, family (its number), pos (the match's number), type, lesson, confidence. One scan
    of the text serves all families."""

    def matches(number: int, pattern: str):
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda m, k: F.struct(F.lit(number).alias("family"), k.alias("pos"), m.alias("m")))

    found = F.flatten(F.array(*(matches(n, f.pattern) for n, f in enumerate(families))))
    rows = texts.select(F.col(key), F.explode(found).alias("x")).select(key, "x.*")
    kind, lesson, sure, fine = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(False)
    for n, f in enumerate(families):
        group = lambda g, f=f: F.regexp_replace(F.regexp_extract("m", f.pattern, g), r"^\s+|\s+$", "")
        parts, rest = [], f.template
        while "{" in rest:
            head, _, tail = rest.partition("{")
            number, _, rest = tail.partition("}")
            parts += [F.lit(head), group(int(number))]
        made = F.concat(*parts, F.lit(rest))
        ok = F.length(group(1)) >= f.least
        for word in f.not_holding:
            ok &= ~F.contains(group(1), F.lit(word))
        here = F.col("family") == n
        kind, lesson = F.when(here, f.kind).otherwise(kind), F.when(here, made).otherwise(lesson)
        sure, fine = F.when(here, f.confidence).otherwise(sure), F.when(here, ok).otherwise(fine)
    return rows.select(key, "family", "pos", kind.alias("type"), lesson.alias("lesson"), sure.alias("confidence"), fine.alias("__ok")).where("__ok").drop("__ok")


def first_seen(rows: DataFrame, text: Column, order: list, within: list[str] | None = None, width: int = 60) -> DataFrame:
    """The first row, in order, of each lower-cased beginning of a text (within some keys).
    A group's minimum, so a common beginning is settled before the shuffle."""
    keys = [F.col(c) for c in within or []] + [F.lower(F.substring(text, 1, width)).alias("__key")]
    first = F.min(F.struct(*(c.alias(f"__o{k}") for k, c in enumerate(order)), F.struct(*rows.columns).alias("row")))
    return rows.groupBy(*keys).agg(first.alias("m")).select("m.row.*")


def terms(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf: counts of lower-cased words of three letters or more. Maximal runs of
    ASCII word characters; a word boundary would be Unicode-aware here and drop some."""
    return texts.select(key, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\w{3,}"), F.lit(0))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def cosine_candidates(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: float) -> DataFrame:
    """left_key, right_key of the pairs that can exceed `least`. Both sides order their terms
    alike, the right side's most frequent first, and leave out the first ones as long as their
    share of the vector's norm cannot reach `least`. Of the terms a pair shares, those that
    one side leaves out include those that the other does, so a pair above `least` shares a
    term that both keep. left, right: (key, term, tf, norm, df)."""

    def kept(rows: DataFrame, key: str) -> DataFrame:
        until = Window.partitionBy(key).orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        share = F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(until)) / F.col("norm")
        return rows.withColumn("__share", share).where(F.col("__share") > least * (1 - 1e-9)).select(key, "term")

    return kept(left, left_key).join(_small(kept(right, right_key), right), "term").select(left_key, right_key).distinct()


def _small(df: DataFrame, of: DataFrame) -> DataFrame:
    """df to be broadcast where `of`, which has as many rows at least, is small."""
    return F.broadcast(df) if of.count() <= BROADCAST_ROWS else df


def cosine_pairs_of_texts(texts: DataFrame, right: DataFrame, key: str, text: str, right_key: str, least: float = 0.0) -> DataFrame:
    """What `cosine_pairs` gives for the terms of texts and few term vectors of a right side.
    Only the texts are shuffled, by their key: counting terms, norms and sums of pairs all
    group by that key first, so nothing made of the texts moves or is stored."""
    right = stored(right, "terms")
    if right.count() > BROADCAST_ROWS:
        return cosine_pairs(terms(texts, key, text), right, key, right_key, least)
    norm = F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("__norm")
    other = right.join(right.groupBy(right_key).agg(norm), right_key).select(right_key, "term", F.col("tf").alias("__tf"), "__norm")
    left = terms(spread(texts.select(key, text), key), key, text)
    left = left.withColumn("norm", F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy(key))))
    cosine = F.sum(F.col("tf") * F.col("__tf")) / (F.first("norm") * F.first("__norm"))
    return left.join(F.broadcast(other), "term").groupBy(key, right_key).agg(cosine.alias("cosine")).where(F.col("cosine") > least)


def cosine_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: float = 0.0) -> DataFrame:
    """left_key, right_key, cosine of term vectors (key, term, tf) above `least`: one join on
    terms, summed for the candidates. A left row without a term of the right side only counts
    in its vector's norm; the right side is broadcast where it has no more than BROADCAST_ROWS
    terms."""
    # Every step below reads the terms; taking them from the texts each time costs far more.
    left, right = stored(left, "terms"), stored(right, "terms")
    norms = lambda v, k: v.groupBy(k).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    df = right.groupBy("term").agg(F.count("*").alias("df"))
    named = stored(right.join(df, "term").join(norms(right, right_key), right_key), "terms-right")
    met = stored(left.join(_small(df, named), "term").join(norms(left, left_key), left_key), "terms-left")
    pairs = cosine_candidates(met, named, left_key, right_key, least)
    other = named.select(right_key, "term", F.col("tf").alias("__tf"), F.col("norm").alias("__norm"))
    dot = met.join(_small(other, named), "term").join(pairs, [left_key, right_key], "left_semi").groupBy(left_key, right_key)
    cosine = F.sum(F.col("tf") * F.col("__tf")) / (F.first("norm") * F.first("__norm"))
    return dot.agg(cosine.alias("cosine")).where(F.col("cosine") > least)


def curate(new: DataFrame, known: DataFrame, key: str, text: str, known_key: str, known_text: str, similar: float = SIMILAR) -> DataFrame:
    """New rows without a known text more similar than the limit; new ones are not compared
    with each other."""
    close = cosine_pairs_of_texts(new, terms(known, known_key, known_text), key, text, known_key, similar).select(key).distinct()
    return new.join(close, key, "left_anti")


def learned(old: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """type, lesson, seq of old lessons and the new ones after them; both have type, lesson and
    their own order. The old ones' greatest number is one row."""
    last = old.agg(F.coalesce(F.max(order), F.lit(-1)).alias("__last"))
    after = new.crossJoin(last).withColumn(order, F.col("__last") + 1 + F.col(order))
    return old.select("type", "lesson", F.col(order).cast("long")).unionByName(after.select("type", "lesson", F.col(order).cast("long")))


def latest(rows: DataFrame, order: list[str], keep: int = KEPT) -> DataFrame:
    """The last rows in order; a top-k, not a sort of everything."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(keep)
