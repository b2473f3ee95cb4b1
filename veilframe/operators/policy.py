"""Policy decisions over rule tables.

A policy arrives as one JSON document per row and is normalised once:

* rules: ``policy_id, pos, entity_type, action, roles, classification``
* exceptions: ``policy_id, pos, agent_id, agent_role, entity_types, action``

Rules are folded to a fixed number of rows per policy before they meet the data,
so a decision never multiplies rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import lookup
from veilframe.functions.constants import (
    CLASSIFICATION_LEVELS,
    COMPLIANCE_PACKS,
    DEFAULT_ACTIONS,
    DEFAULT_CLASSES,
    STRICTNESS,
    UNKNOWN_STRICTNESS,
)
from veilframe.functions.ordered import running_total
from veilframe.functions.prefilter import literal
from veilframe.sources.staging import stage_files

_RULE = "struct<entity_type:string,action:string,roles:array<string>,classification:string>"
_EXCEPTION = "struct<agent_id:string,agent_role:string,entity_types:array<string>,action:string>"


def rules_of(policies: DataFrame, document: str = "document") -> DataFrame:
    """The rule table of JSON policies (``policy_id`` and the document)."""
    parsed = policies.select(
        "policy_id", F.posexplode(F.from_json(document, f"struct<rules:array<{_RULE}>>")["rules"]).alias("pos", "r")
    )
    return parsed.select("policy_id", "pos", "r.*").withColumn("action", F.upper(F.coalesce("action", F.lit("REDACT"))))


def exceptions_of(policies: DataFrame, document: str = "document") -> DataFrame:
    """The exception table of JSON policies."""
    parsed = policies.select(
        "policy_id",
        F.posexplode(F.from_json(document, f"struct<exceptions:array<{_EXCEPTION}>>")["exceptions"]).alias("pos", "x"),
    )
    return parsed.select("policy_id", "pos", "x.*").withColumn("action", F.upper(F.coalesce("action", F.lit("PASS"))))


def packs_of(policies: DataFrame, document: str = "document") -> DataFrame:
    """Compliance packs per policy; a single name counts as a list of one."""
    shape = F.get_json_object(document, "$.compliance_packs")
    packs = F.coalesce(F.from_json(shape, "array<string>"), F.when(shape.isNotNull(), F.array(shape)))
    return policies.select("policy_id", F.coalesce(packs, F.array().cast("array<string>")).alias("compliance_packs"))


def strictness(action: Column) -> Column:
    return lookup.get(lookup.int_map(STRICTNESS), F.upper(action), UNKNOWN_STRICTNESS)


def most_restrictive(a: Column, b: Column) -> Column:
    """The stricter action; the first one if both are equally strict."""
    return F.when(strictness(a) >= strictness(b), a).otherwise(b)


def compliance_refs(entity_type: Column, action: Column, packs: Column) -> Column:
    """``PACK: ACTION required`` for the packs that ``action`` satisfies, in order."""
    table = lookup.nested_map(COMPLIANCE_PACKS)

    def demand(pack):
        rules = F.coalesce(F.try_element_at(table, pack), F.try_element_at(table, F.replace(pack, F.lit("-"), F.lit("_"))))
        return F.struct(pack.alias("pack"), F.try_element_at(rules, entity_type).alias("action"))

    met = F.filter(
        F.transform(packs, demand),
        lambda d: d["action"].isNotNull()
        & (lookup.get(lookup.int_map(STRICTNESS), action, UNKNOWN_STRICTNESS) >= strictness(d["action"])),
    )
    return F.transform(met, lambda d: F.concat(d["pack"], F.lit(": "), d["action"], F.lit(" required")))


#: A policy's types are dealt to so many rows.
TYPE_ROWS = 4

_RULES, _AGENTS, _ROLES = 0, 1, 2


def _place(entity_type: str | Column) -> dict[str, Column]:
    """The row of a policy that speaks of ``entity_type``.  The hash comes first: rows are
    then sorted by a number and not by long names that begin alike."""
    row = F.pmod(F.hash(entity_type), F.lit(TYPE_ROWS))
    return {"_key": F.xxhash64("policy_id", row), "policy_id": F.col("policy_id"), "_row": row}


def _folded(rules: DataFrame, exceptions: DataFrame | None, packs: DataFrame | None) -> DataFrame:
    """``TYPE_ROWS`` rows per policy, however often it repeats itself: ``_said`` (the last
    position of every distinct rule, and of every distinct exception for an agent or a role,
    with its type) and ``compliance_packs``."""

    def said(df: DataFrame, kind: Column, whom: Column) -> DataFrame:
        return df.select(
            "policy_id", "entity_type", kind.cast("tinyint").alias("kind"), "action", whom.alias("whom"), F.col("pos").cast("bigint").alias("pos")
        ).where("entity_type IS NOT NULL")

    roles = F.when(F.size("roles") > 0, F.array_sort(F.array_distinct("roles")))
    every = said(rules, F.lit(_RULES), roles)
    if exceptions is not None:
        listed = exceptions.select("policy_id", "pos", "agent_id", "agent_role", "action", F.explode("entity_types").alias("entity_type"))
        names = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("who")) for k, c in ((_AGENTS, "agent_id"), (_ROLES, "agent_role"))])
        named = listed.select("policy_id", "entity_type", "action", "pos", F.inline(F.filter(names, lambda n: n["who"].isNotNull())))
        every = every.union(said(named, F.col("kind"), F.array("who")))
    # Only a number is aggregated here, so that the rows are hashed and not sorted.
    last = every.groupBy("policy_id", "entity_type", "kind", "action", "whom").agg(F.max("pos").alias("pos"))
    none = F.lit(None).cast("array<string>")
    whole = last.select(
        *[c.alias(n) for n, c in _place("entity_type").items()],
        F.struct("entity_type", "kind", "pos", "action", "whom").alias("_one"),
        none.alias("_packs"),
    )
    if packs is not None:
        row = F.explode(F.sequence(F.lit(0), F.lit(TYPE_ROWS - 1)))
        each = packs.select("policy_id", "compliance_packs", row.alias("_row"))
        key = F.xxhash64("policy_id", "_row").alias("_key")
        whole = whole.unionByName(
            each.select(key, "policy_id", "_row", F.lit(None).cast(whole.schema["_one"].dataType).alias("_one"), F.col("compliance_packs").alias("_packs"))
        )
    # Dealt out before they are gathered: next to no two rows of a place stand in one task,
    # and gathering them there first would sort all of them in vain.
    place = ["_key", "policy_id", "_row"]
    return whole.repartition(*place).groupBy(*place).agg(
        F.collect_list("_one").alias("_said"), F.first("_packs", ignorenulls=True).alias("compliance_packs")
    )


def evaluate(
    entities: DataFrame, rules: DataFrame, exceptions: DataFrame | None = None, packs: DataFrame | None = None
) -> DataFrame:
    """Decide every row of ``entities`` (``policy_id, entity_type`` and, where known,
    ``agent_id, agent_role``): adds ``action, reason, compliance_refs, overridden_by``.

    Exception over last matching rule over default over REDACT.  All that a policy says
    about a type is in one row, with other types, so ``entities`` are shuffled once, or not at all if the
    policies are small.
    """
    df = entities
    for name in ("agent_id", "agent_role"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    df = df.withColumns({k: c for k, c in _place("entity_type").items() if k != "policy_id"})
    df = df.join(_folded(rules, exceptions, packs), ["_key", "policy_id", "_row"], "left")
    agent, role = F.col("agent_id"), F.col("agent_role")

    def last(matching) -> Column:
        found = F.filter("_said", lambda s: (s["entity_type"] == F.col("entity_type")) & matching(s))
        return F.array_max(F.transform(found, lambda s: F.struct(s["pos"], s["action"])))["action"]

    ruled = last(lambda s: (s["kind"] == _RULES) & (s["whom"].isNull() | role.isNull() | F.array_contains(s["whom"], role)))
    granted = last(lambda s: ((s["kind"] == _AGENTS) & (F.get(s["whom"], 0) == agent)) | ((s["kind"] == _ROLES) & (F.get(s["whom"], 0) == role)))
    default = F.try_element_at(lookup.text_map(DEFAULT_ACTIONS), F.col("entity_type"))
    who = F.coalesce("agent_id", "agent_role")
    df = df.withColumns({"_granted": granted, "_ruled": ruled})
    action = F.coalesce("_granted", "_ruled", default, F.lit("REDACT"))
    # The reasons' texts.
    reason = (
        F.when(F.col("_granted").isNotNull(), F.concat(F.lit("Exception granted for "), who))
        .when(F.col("_ruled").isNotNull(), F.concat(F.lit("Policy rule for "), F.col("entity_type")))
        .when(default.isNotNull(), "Default policy")
        .otherwise("Default deny — unknown entity type")
    )
    no_packs = F.array().cast("array<string>")
    return df.withColumn("action", action).select(
        *entities.columns,
        "action",
        reason.alias("reason"),
        F.coalesce(compliance_refs(F.col("entity_type"), F.col("action"), F.col("compliance_packs")), no_packs).alias(
            "compliance_refs"
        ),
        F.when(F.col("_granted").isNotNull(), F.concat(F.lit("exception:"), who)).alias("overridden_by"),
    )


_TYPE = ["policy_id", "entity_type"]


_VARIANT = [*_TYPE, "action", "roles"]

#: Up to so many places of a rule are kept in its row, and up to four times as many lines
#: of a type are gathered in one row.
MAX_PLACES = 128


def _variant(action: str, roles: str) -> Column:
    """Equal for rules of equal action and roles."""
    return F.sha2(F.to_json(F.struct(F.col(action).alias("action"), F.col(roles).alias("roles"))), 256)


def _variants(placed: DataFrame, max_places: int) -> DataFrame:
    """Different rules with their first place, their number of places, and all of these if
    they are between two and ``max_places``: a rule of more places is never gathered."""
    places = F.lit(None).cast(f"array<{placed.schema['pos'].dataType.simpleString()}>")
    counted = stage_files(placed.groupBy(*_VARIANT).agg(F.min("pos").alias("first_pos"), F.count("*").alias("n")), "variants")
    few = counted.where(F.col("n").between(2, max_places)).select(*_VARIANT)
    listed = placed.join(few, _VARIANT).groupBy(*_VARIANT)
    listed = listed.agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"), F.collect_list("pos").alias("places"))
    return stage_files(counted.where(~F.col("n").between(2, max_places)).withColumn("places", places).union(listed), "places")


def _meeting(variants: DataFrame) -> DataFrame:
    """Pairs of variants ``_a, _b`` of one policy and type with different actions whose
    roles meet; ``_a`` occurs first.

    Variants meet in an index: under each of their roles, or, without roles, in a list of
    the type's variants.  Under a role, variants of the same action are never paired: each
    is sent to the greater actions found there, and a pair counts under the least role it
    shares.  So pairs come out of the last join once, and are not shuffled again."""
    whole = F.struct("first_pos", "action", "roles", "n", "places")
    by_role = variants.select(*_TYPE, "action", whole.alias("v"), F.explode("roles").alias("role"))
    each = variants.select(*_TYPE, "action", whole.alias("v"))
    free, bound = each.where(F.size("v.roles") == 0), each.where(F.size("v.roles") > 0)

    def opposed(left: DataFrame, right: DataFrame, place: list[str], others) -> DataFrame:
        there = right.groupBy(*place).agg(F.collect_set("action").alias("actions"))
        sent = left.join(there, place).select(*place, F.col("v").alias("x"), F.explode(F.filter("actions", others)).alias("action"))
        return sent.join(right.withColumnRenamed("v", "y"), [*place, "action"])

    def greater(other: Column) -> Column:
        return other > F.col("action")

    shared = F.array_intersect("x.roles", "y.roles")
    pairs = (
        opposed(by_role, by_role, [*_TYPE, "role"], greater).where(F.col("role") == F.array_min(shared)).select(*_TYPE, "x", "y")
        .union(opposed(free, free, _TYPE, greater).select(*_TYPE, "x", "y"))
        .union(opposed(free, bound, _TYPE, lambda other: other != F.col("action")).select(*_TYPE, "x", "y"))
    )
    return _first_is_a(pairs)


def _paired(placed: DataFrame) -> DataFrame:
    """The same pairs of types of few lines, whose rules are gathered in a row.  Lines are
    shuffled once, by type: what follows finds them where they are.  Rules of the same action
    are never paired."""
    folded = placed.repartition(*_TYPE).groupBy(*_VARIANT)
    folded = folded.agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"), F.collect_list("pos").alias("places"))
    by_action = folded.groupBy(*_TYPE, "action").agg(F.collect_list(F.struct("first_pos", "action", "roles", "n", "places")).alias("v"))
    types = by_action.groupBy(*_TYPE).agg(F.collect_list(F.struct("action", "v")).alias("actions")).where(F.size("actions") > 1)
    opposed = types.select(*_TYPE, "actions", F.explode("actions").alias("x")).select(*_TYPE, "x", F.explode("actions").alias("y"))
    each = opposed.where(F.col("x.action") < F.col("y.action")).select(*_TYPE, F.explode("x.v").alias("x"), F.col("y.v").alias("y"))
    each = each.select(*_TYPE, "x", F.explode("y").alias("y"))
    free = (F.size("x.roles") == 0) | (F.size("y.roles") == 0)
    return _first_is_a(each.where(free | F.arrays_overlap("x.roles", "y.roles")))


def _first_is_a(pairs: DataFrame) -> DataFrame:
    swap = F.struct("y.first_pos", "y.action") < F.struct("x.first_pos", "x.action")
    return pairs.select(*_TYPE, F.when(swap, F.col("y")).otherwise(F.col("x")).alias("_a"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("_b"))


def _in_order() -> Column:
    """How many places of ``_a`` and ``_b``, both in their rows, are in order.  A few are
    compared one by one, more are merged."""

    def places(v: str) -> Column:
        return F.coalesce(F.col(f"{v}.places"), F.array(f"{v}.first_pos"))

    def marked(v: str, later: bool) -> Column:
        return F.transform(places(v), lambda at: F.struct(at.alias("pos"), F.lit(later).alias("later")))

    none = F.lit(0).cast("bigint")
    few = F.aggregate(places("_a"), none, lambda acc, at: acc + F.size(F.filter(places("_b"), lambda other: other > at)))

    # Of equal places, which rules of one policy do not have, that of ``_b`` comes first.
    merged = F.array_sort(F.concat(marked("_a", True), marked("_b", False)))
    start = F.struct(none.alias("before"), none.alias("pairs"))
    more = F.aggregate(
        merged, start,
        lambda acc, place: F.struct(
            (acc["before"] + F.when(place["later"], 1).otherwise(0)).alias("before"),
            (acc["pairs"] + F.when(place["later"], 0).otherwise(acc["before"])).alias("pairs"),
        ),
        lambda acc: acc["pairs"],
    )
    return F.when(F.col("_a.n") * F.col("_b.n") <= 64, few).otherwise(more)


def conflicts(rules: DataFrame, max_places: int = MAX_PLACES) -> DataFrame:
    """Rules of one policy and type that ask for different actions of the same role; a
    rule's ``pos`` is its own within the policy.

    Equal rules are folded first: there is one row for a pair of rules, however often a
    policy repeats them, and ``a`` is the one that occurs first.  ``rule_pairs`` counts
    the pairs of their places, ``in_order`` those with ``a`` before ``b`` (the first being
    ``pos_a, pos_b``) and ``reversed`` the others (the first being ``pos_b, next_pos_a``).

    Of two rules that have a place each there is nothing to count.  Where a type has up to
    four times ``max_places`` lines, its rules are gathered in one row and paired there.
    In larger types rules meet in an index; up to ``max_places`` places are in the rule's
    row.  Both rows' places are merged.  For rules of more
    places the counts come from running numbers over the places of the rule that occurs
    more often, read at the places of the other one, in buckets: places are not paired.
    """
    roles = F.array_sort(F.array_distinct(F.coalesce("roles", F.array().cast("array<string>"))))
    named = "policy_id IS NOT NULL AND entity_type IS NOT NULL AND action IS NOT NULL"
    placed = rules.where(named).select(*_TYPE, "pos", "action", roles.alias("roles"))
    sizes = placed.groupBy(*_TYPE).agg(F.count("*").alias("lines"))
    large = stage_files(sizes.where(F.col("lines") > 4 * max_places).select(*_TYPE), "large")
    if large.isEmpty():
        return _described(_in_rows(_paired(placed)))
    few, many = (placed.join(large, _TYPE, how) for how in ("left_anti", "left_semi"))
    return _described(_in_rows(_paired(few)).unionByName(_indexed(many, max_places)))


def _in_rows(pairs: DataFrame) -> DataFrame:
    """``in_order`` and ``next_pos_a`` of pairs of rules whose places are in their rows."""
    single = F.col("_a.n") * F.col("_b.n") == 1
    later = F.array_min(F.filter("_a.places", lambda at: at > F.col("_b.first_pos")))
    return pairs.withColumns({
        "in_order": F.when(single, F.lit(1).cast("bigint")).otherwise(_in_order()),
        "next_pos_a": F.when(F.col("_a.n") > 1, later),
    })


def _indexed(placed: DataFrame, max_places: int) -> DataFrame:
    """The pairs of rules that meet in the index, with their counts."""
    variants = _variants(placed, max_places)
    many = F.greatest("_a.n", "_b.n") > max_places
    pairs = _meeting(variants)
    whole = _in_rows(pairs.where(~many))
    if not variants.where(F.col("n") > max_places).isEmpty():
        named = {"a": _variant("_a.action", "_a.roles"), "b": _variant("_b.action", "_b.roles")}
        rest = stage_files(pairs.where(many).withColumns(named), "pairs")
        counts = _counted(placed.withColumn("variant", _variant("action", "roles")), rest)
        whole = whole.unionByName(rest.join(counts, [*_TYPE, "a", "b"]).drop("a", "b"))
    return whole


def _described(pairs: DataFrame) -> DataFrame:
    total = F.col("_a.n") * F.col("_b.n")
    return pairs.select(
        *_TYPE,
        F.col("_a.first_pos").alias("pos_a"),
        F.col("_a.action").alias("action_a"),
        F.col("_b.first_pos").alias("pos_b"),
        F.col("_b.action").alias("action_b"),
        total.alias("rule_pairs"),
        "in_order",
        (total - F.col("in_order")).alias("reversed"),
        "next_pos_a",
        _clash(F.col("_a.action"), F.col("_b.action")).alias("description"),
    )


def _counted(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """``in_order`` and ``next_pos_a`` of pairs of rules."""
    often_a = F.col("_a.n") >= F.col("_b.n")
    often, rare = F.when(often_a, F.col("a")).otherwise(F.col("b")), F.when(often_a, F.col("b")).otherwise(F.col("a"))
    at, none = placed.select(*_TYPE, "variant", "pos"), F.lit(None).cast("string")
    own = at.join(pairs.select(*_TYPE, F.explode(F.array("a", "b")).alias("variant")).distinct(), [*_TYPE, "variant"])
    asked = pairs.select(*_TYPE, "a", "b", often.alias("often"), rare.alias("variant")).join(at, [*_TYPE, "variant"])
    after = pairs.select(*_TYPE, F.col("a").alias("variant"), F.col("_b.first_pos").alias("pos"), "a", "b", F.lit("next").alias("use"))
    numbered = running_total(
        own.select(*_TYPE, "variant", "pos", none.alias("a"), none.alias("b"), F.lit("own").alias("use"))
        .union(asked.select(*_TYPE, F.col("often").alias("variant"), "pos", "a", "b", F.lit("count").alias("use")))
        .union(after.select(*_TYPE, "variant", "pos", "a", "b", "use"))
        .withColumn("one", F.when(F.col("use") == "own", 1).otherwise(0)),
        [*_TYPE, "variant"], "pos", "one", "upto",
    )
    pair = [*_TYPE, "a", "b"]
    counted = numbered.where("use = 'count'").groupBy(*pair).agg(F.sum("upto").alias("_before"))
    places = numbered.where("use = 'own'").select(*_TYPE, "variant", F.col("upto").alias("nth"), F.col("pos").alias("next_pos_a"))
    following = numbered.where("use = 'next'").select(*pair, F.col("a").alias("variant"), (F.col("upto") + 1).alias("nth"))
    following = following.join(places, [*_TYPE, "variant", "nth"]).select(*pair, "next_pos_a")
    in_order = F.when(often_a, F.col("_before")).otherwise(F.col("_a.n") * F.col("_b.n") - F.col("_before"))
    counts = pairs.join(counted, pair).join(following, pair, "left")
    return counts.select(*pair, in_order.alias("in_order"), "next_pos_a")


def _clash(first: Column, second: Column) -> Column:
    # The text of a conflict.
    shared = F.array_intersect("_a.roles", "_b.roles")  # in the order of ``_a.roles``, which are sorted
    roles = F.when(F.size(shared) > 0, F.concat(F.lit(" for overlapping roles "), F.array_join(shared, ", "))).otherwise("")
    return F.concat(F.col("entity_type"), F.lit(": conflicting actions "), first, F.lit(" vs "), second, roles)


def compliance_mapping(types: DataFrame) -> DataFrame:
    """What each pack asks for per ``entity_type``, ``N/A`` where it says nothing."""
    packs = {
        name: F.coalesce(F.try_element_at(lookup.text_map(rules), F.col("entity_type")), F.lit("N/A"))
        for name, rules in COMPLIANCE_PACKS.items()
    }
    return types.withColumns(packs)


def pack_rules(df: DataFrame, pack: str = "pack") -> DataFrame:
    """The rules of the named packs; names are matched without case, ``-`` and blanks."""
    name = F.translate(F.upper(pack), "- ", "__")
    rules = F.try_element_at(lookup.nested_map(COMPLIANCE_PACKS), name)
    return df.select("*", F.explode(rules).alias("entity_type", "action"))


def classify(entity_type: Column) -> Column:
    """The data class of an entity type; null for types without one."""
    return F.try_element_at(lookup.text_map(DEFAULT_CLASSES), entity_type)


def classify_groups(detections: DataFrame, *keys: str) -> DataFrame:
    """The highest data class found per group, e.g. per document or per source."""
    level = F.try_element_at(lookup.int_map(CLASSIFICATION_LEVELS), classify(F.col("entity_type")))
    top = F.max(F.coalesce(level, F.lit(0))).alias("level")
    names = F.create_map(*[F.lit(x) for name, n in CLASSIFICATION_LEVELS.items() for x in (n, name)])
    return detections.groupBy(*keys).agg(top, F.count("*").alias("entities")).withColumn(
        "classification", F.coalesce(F.try_element_at(names, F.col("level")), F.lit("UNCLASSIFIED"))
    )


def validate(policies: DataFrame, document: str = "document") -> DataFrame:
    """Errors and warnings per policy document, and whether it is valid."""
    doc = F.try_parse_json(document)

    def kind(v: Column) -> Column:
        return F.split(F.schema_of_variant(v), "<")[0]

    def problems(items: Column, per_item) -> Column:
        return F.flatten(F.transform(items, lambda v, i: F.array_compact(F.array(*per_item(v, i)))))

    def at(what: str, i: Column, text: Column | str) -> Column:
        return F.concat(F.lit(f"{what} "), i.cast("string"), F.lit(": "), F.lit(text) if isinstance(text, str) else text)

    known = sorted(STRICTNESS)

    # The texts of errors and warnings.
    def of_rule(v, i):
        is_map = kind(v) == "OBJECT"
        action = F.upper(F.coalesce(F.try_variant_get(v, "$.action", "string"), F.lit("")))
        roles = F.try_variant_get(v, "$.roles", "variant")
        unknown = F.concat(
            F.lit("unknown action '"), action, F.lit(f"'. Valid: [{', '.join(repr(k) for k in known)}]")
        )
        return (
            F.when(~is_map, at("Rule", i, "must be a mapping")),
            F.when(is_map & F.try_variant_get(v, "$.entity_type", "variant").isNull(), at("Rule", i, "missing 'entity_type'")),
            F.when(is_map & (action != "") & ~action.isin(known), at("Rule", i, unknown)),
            F.when(is_map & roles.isNotNull() & ~F.is_variant_null(roles) & (kind(roles) != "ARRAY"),
                   at("Rule", i, "'roles' must be a list")),
        )

    def of_exception(v, i):
        return (F.when(kind(v) != "OBJECT", at("Exception", i, "must be a mapping")),)

    def unmatched(v, i):
        nobody = F.try_variant_get(v, "$.agent_id", "variant").isNull() & F.try_variant_get(v, "$.agent_role", "variant").isNull()
        return (F.when((kind(v) == "OBJECT") & nobody,
                       at("Exception", i, "no agent_id or agent_role specified — will never match")),)

    root = kind(doc) == "OBJECT"
    base = policies.select(
        "policy_id",
        F.col(document).alias("_document"),
        doc.isNull().alias("_unreadable"),
        F.coalesce(root, F.lit(False)).alias("_root"),
        F.when(root, F.try_variant_get(doc, "$.rules", "variant")).alias("_r"),
        F.when(root, F.try_variant_get(doc, "$.exceptions", "variant")).alias("_x"),
    )

    def absent(c: str) -> Column:
        return F.col(c).isNull() | F.is_variant_null(c)

    def listed(c: str) -> Column:
        return F.when(~absent(c) & (kind(F.col(c)) == "ARRAY"), F.try_variant_get(c, "$", "array<variant>"))

    none = F.array().cast("array<string>")

    def one(condition: Column, text: str) -> Column:
        return F.when(condition, F.array(F.lit(text))).otherwise(none)

    parts = base.withColumns({"_rules": listed("_r"), "_exceptions": listed("_x")})
    checked = parts.select(
        "policy_id",
        "_document",
        F.concat(
            one(F.col("_unreadable"), "Invalid document"),
            one(~F.col("_unreadable") & ~F.col("_root"), "Root element must be a mapping"),
            one(~absent("_r") & F.col("_rules").isNull(), "'rules' must be a list"),
            F.coalesce(problems(F.col("_rules"), of_rule), none),
            one(~absent("_x") & F.col("_exceptions").isNull(), "'exceptions' must be a list"),
            F.coalesce(problems(F.col("_exceptions"), of_exception), none),
        ).alias("errors"),
        F.concat(
            one(F.col("_root") & absent("_r"), "No 'rules' key found — all entities will use default actions"),
            F.coalesce(problems(F.col("_exceptions"), unmatched), none),
        ).alias("_warnings"),
    )
    found = conflicts(rules_of(policies, document))
    swapped = F.replace("description", F.concat("action_a", F.lit(" vs "), "action_b"), F.concat("action_b", F.lit(" vs "), "action_a"))
    back = found.where("reversed > 0").select("policy_id", "entity_type", F.col("pos_b").alias("pos_a"), F.col("next_pos_a").alias("pos_b"), swapped.alias("description"))
    clashes = (
        found.select("policy_id", "entity_type", "pos_a", "pos_b", "description")
        .union(back)
        .groupBy("policy_id")
        .agg(F.array_sort(F.collect_list(F.struct("entity_type", "pos_a", "pos_b", "description"))).alias("_c"))
        .select("policy_id", F.transform("_c", lambda c: F.concat(F.lit("Conflict: "), c["description"])).alias("_clashes"))
    )
    valid = F.size("errors") == 0
    return checked.join(clashes, "policy_id", "left").select(
        "policy_id",
        valid.alias("valid"),
        "errors",
        F.when(valid, F.concat("_warnings", F.coalesce("_clashes", none))).otherwise(F.col("_warnings")).alias("warnings"),
    )


def diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("policy_id",)) -> DataFrame:
    """Changes between two versions of rule tables: rules ADDED or REMOVED, fields
    MODIFIED.  Of several rules for a type the last one counts."""

    def last(rules: DataFrame, name: str) -> DataFrame:
        folded = rules.where("entity_type IS NOT NULL").groupBy(*keys, "entity_type").agg(
            F.max_by(F.struct("action", "roles", "classification"), "pos").alias(name)
        )
        return folded

    both = last(old, "o").join(last(new, "n"), [*keys, "entity_type"], "full_outer")

    def change(field: str, old_value: Column, new_value: Column, kind: Column | str) -> Column:
        return F.struct(
            F.lit(field).alias("field"),
            old_value.alias("old_value"),
            new_value.alias("new_value"),
            (F.lit(kind) if isinstance(kind, str) else kind).alias("change_type"),
        )

    null = F.lit(None).cast("string")

    def as_text(name: str, field: str) -> Column:
        value = F.col(f"{name}.{field}")
        return F.to_json(value) if field == "roles" else value

    whole = F.when(F.col("o").isNull(), F.array(change("rule", null, F.to_json("n"), "ADDED"))).when(
        F.col("n").isNull(), F.array(change("rule", F.to_json("o"), null, "REMOVED"))
    )
    modified = F.array_compact(
        F.array(
            *[
                F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), change(f, as_text("o", f), as_text("n", f), "MODIFIED"))
                for f in ("action", "roles", "classification")
            ]
        )
    )
    return both.select(*keys, "entity_type", F.inline(F.coalesce(whole, modified)))


TOP_FIELDS = ("version", "retention_days", "audit", "right_to_erasure")


def diff_settings(old: DataFrame, new: DataFrame, document: str = "document") -> DataFrame:
    """Changes of the top-level fields of two versions of policy documents."""

    def fields(policies: DataFrame, name: str) -> DataFrame:
        values = [F.get_json_object(document, f"$.{f}").alias(f) for f in TOP_FIELDS]
        return policies.select("policy_id", *values).unpivot("policy_id", list(TOP_FIELDS), "field", name)

    both = fields(old, "old_value").join(fields(new, "new_value"), ["policy_id", "field"], "full_outer")
    kind = F.when(F.col("old_value").isNull(), "ADDED").when(F.col("new_value").isNull(), "REMOVED").otherwise("MODIFIED")
    changed = both.where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    return changed.select(
        "policy_id", F.lit("*").alias("entity_type"), "field", "old_value", "new_value", kind.alias("change_type")
    )


def list_policies(policies: DataFrame, status: str | None = None) -> DataFrame:
    """Policies, newest first."""
    chosen = policies if status is None else policies.where(F.col("status") == status)
    return chosen.orderBy(F.desc("created_at"), "policy_id")


def named_frameworks(policies: DataFrame, codes: Sequence[str]) -> DataFrame:
    """The framework ``code``s that some active policy names in its pack list."""
    listed = ", ".join(literal(c) for c in codes)
    named = F.expr(f"filter(array({listed}), c -> compliance_packs ILIKE concat('%', c, '%'))")
    return policies.where("status = 'ACTIVE'").select(F.explode(named).alias("code")).distinct()
