"""Duplicate removal across sources.

Two postings are duplicates when they have the same title and matching companies,
or titles more than 90 % alike and matching companies, or the same title and the
same known deadline.  Going from the newest posting to the oldest, a posting stays
unless it duplicates one that stays.

The rule is evaluated without ever listing the pairs of a group:

* Postings equal in title key, company keys and deadline key behave alike.  One
  aggregation keeps the newest of each such *signature*; the rest are removed.
* Postings with equal title and equal deadline (or company key, or company base)
  are all duplicates of each other.  Such a *unit* is only ever reduced to its
  newest undecided member.
* Everything else is a link between two units whose titles or companies are merely
  similar.  Links are found on distinct titles inside distinct companies by joining
  on rare q-gram combinations and are verified one by one.

Rounds then decide postings: one is kept when it is the newest undecided member of
all its units and no linked unit has a newer one; what it duplicates is removed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.similarity import COMPANY, KNOWN_GRAMS, MARKS, TITLE, LengthPlan, Threshold, both_above, letter_counts, repeated_marks
from jobloom.functions.text import company_base, company_key, date_key, deadline_key, let, title_key
from jobloom.session import dropped, ensure_checkpoint_dir, written


@dataclass(frozen=True)
class Blocking:
    """Block sizes from which keys combine two, three or four grams, or need a gram at all.

    Speed only, never the result.
    """

    two_grams_from: int = 2_000
    three_grams_from: int = 50_000
    four_grams_from: int = 2_000_000
    one_gram_from: int = 33

    def level(self, members: Column) -> Column:
        return (
            F.when(members >= self.four_grams_from, 4)
            .when(members >= self.three_grams_from, 3)
            .when(members >= self.two_grams_from, 2)
            .when(members >= self.one_gram_from, 1)
            .otherwise(0)
        )

    def level_of(self, members: int) -> int:
        """:meth:`level` of a plain number."""
        bounds = [(self.four_grams_from, 4), (self.three_grams_from, 3), (self.two_grams_from, 2), (self.one_gram_from, 1)]
        return next((k for least, k in bounds if members >= least), 0)


DEFAULT_BLOCKING = Blocking()


def with_duplicate_keys(active: DataFrame, fold_acronym: bool = False) -> DataFrame:
    """Title key, company key, company base, deadline key and the newest-first position."""
    dated = dict(active.dtypes)["deadline"] in ("date", "timestamp")
    key = date_key("deadline") if dated else deadline_key("deadline")
    newest = F.coalesce(-F.unix_micros("scraped_at"), F.lit(-(2**63) + 1))
    return active.withColumns(
        {
            "t": title_key("title"),
            "n": company_key("company", fold_acronym),
            "b": company_base("company"),
            "dl": key,
            "pos": F.struct(newest.alias("neg"), F.col("id").alias("id")),
        }
    )


# --- company matches --------------------------------------------------------


def _on_keys(keyed: DataFrame, *keys: str) -> DataFrame:
    """Partition by hash into the session's full number of partitions.

    Cutting and comparing strings costs CPU, not bytes; size-based coalescing would
    put the work on a few cores.
    """
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, *keys)


def _both_ratios(pairs: DataFrame, a: str, b: str, threshold: Threshold) -> DataFrame:
    """Verify pairs in both directions; at least one must pass."""
    plausible = threshold.plausible(F.col(a), F.col(b), F.col("_counts_a"), F.col("_counts_b"))
    return (
        pairs.filter(plausible)
        .drop("_counts_a", "_counts_b")
        .distinct()
        .withColumn("_above", both_above(F.col(a), F.col(b), threshold.value))
        .filter("_above > 0")
        .withColumns({"ab": F.col("_above") % 2 == 1, "ba": F.col("_above") > 1})
        .drop("_above")
    )


def similar_names(names: DataFrame, blocking: Blocking = DEFAULT_BLOCKING) -> DataFrame:
    """(a, b, ab, ba): distinct company keys of four characters or more, over 85 % alike.

    Names meet per two lengths, see :class:`LengthPlan`; only numbers are exchanged for that.
    Hardly any subsequence of a name is one of another name too, so the keys go through once
    without owners, four bytes each, and those that occur more than once go on with them.
    """
    sc = names.sparkSession.sparkContext
    distinct = names.filter(F.length("n") >= 4).select("n").distinct()
    named = written(distinct.select(F.monotonically_increasing_id().alias("id"), "n"), "names")
    sizes = {r.size: r["count"] for r in named.groupBy(F.length("n").alias("size")).count().collect()}
    plan = LengthPlan(COMPANY, sizes, blocking.level_of)
    spread = _on_keys(named, "id")
    counts = spread.mapInArrow(plan.gram_counts, "size int, gram string, n long").groupBy("size", "gram").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "size", "gram").limit(KNOWN_GRAMS + 1).collect() if plan.grams else []
    known, whole = {(r["size"], r["gram"]): r["n"] for r in top[:KNOWN_GRAMS]}, len(top) <= KNOWN_GRAMS
    if whole:
        plan.ask_for_more(sizes, known)
    marks = sc.broadcast(_repeated_keys(spread, plan, sum(sizes.values()))) if plan.cuts else None
    keyed = spread.mapInArrow(lambda it: plan.keys(it, known, whole, marks and marks.value), "key long, side byte, id long")
    a, b = (keyed.select("key", F.col("side").alias(f"side_{x}"), F.col("id").alias(f"id_{x}")) for x in "ab")
    # a name has many keys, which the estimate before the join does not know; names of one
    # length have one side only and meet each other once
    met = a.hint("merge").join(b, "key").filter("side_a < side_b OR (side_a = side_b AND id_a < id_b)").select("id_a", "id_b").distinct()
    first, second = (named.select(F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    pairs = met.join(first, "id_a").join(second, "id_b").select(F.least("n_a", "n_b").alias("a"), F.greatest("n_a", "n_b").alias("b"))
    counts = {f"_counts_{x}": letter_counts(F.col(x)) for x in "ab"}
    similar = written(_both_ratios(pairs.withColumns(counts), "a", "b", COMPANY), "similar-names")
    dropped(named)
    if marks:
        marks.destroy()
    return similar


def _repeated_keys(spread: DataFrame, plan: LengthPlan, names: int) -> np.ndarray:
    """Marks (bucket, bytes) of the keys of subsequences that occur more than once; of others, a few.

    Their size is bounded: with very many such keys they only leave fewer out.
    """
    buckets = 16
    while buckets * 4096 < names and buckets < MARKS >> 10:
        buckets *= 2
    size = max(64, min(MARKS, 64 * names) // buckets)
    sketches = spread.mapInArrow(lambda it: plan.sketches(it, buckets), "bucket int, keys binary")
    found = sketches.groupBy("bucket").applyInArrow(repeated_marks(size), "bucket int, marks binary")
    out = np.zeros((buckets, size), np.uint8)
    for r in found.collect():
        out[r["bucket"]] = np.frombuffer(zlib.decompress(r["marks"]), np.uint8)
    return out


def contained_bases(bases: DataFrame) -> DataFrame:
    """(a, b): distinct company bases, ``a`` a proper part of ``b``.

    Every gram of the part occurs in the whole, so the part waits under one of its
    rarer ones and the whole visits each of its own.  Parts of eight characters or
    more wait under 8-grams, shorter ones under 4-grams.
    """
    distinct = written(bases.filter(F.col("b").isNotNull()).select("b").distinct(), "bases")

    def met(q: int, of_size: Column) -> DataFrame:
        cut = Threshold(0, 1, q=q)
        waiting = distinct.filter(of_size)
        late = F.split(F.lit("\x02".join(cut.frequent_grams(waiting, "b"))), "\x02")
        rarest = let(
            cut.grams(F.col("b")),
            lambda g: F.get(F.concat(F.array_except(g, late), F.array_intersect(late, g)), F.lit(0)),
        )
        parts = waiting.select(F.col("b").alias("a"), rarest.alias("_key"))
        wholes = distinct.filter(F.length("b") > q).select("b", F.explode(cut.grams(F.col("b"))).alias("_key"))
        return parts.join(wholes, "_key")

    found = (
        met(8, F.length("b") >= 8)
        .unionByName(met(4, F.length("b") < 8))
        .filter((F.length("a") < F.length("b")) & F.contains(F.col("b"), F.col("a")))
        .select("a", "b", F.lit(True).alias("ab"), F.lit(True).alias("ba"))
    )
    out = written(found, "contained-bases")
    dropped(distinct)
    return out


# --- links between units ----------------------------------------------------


def _unit(kind: str, value: Column, t: Column) -> Column:
    """The 16 bytes that stand for a unit."""
    return F.unhex(F.md5(F.concat_ws("\x01", F.lit(kind), value, t)))


def _links(
    units: DataFrame, matches: DataFrame, inner: DataFrame | None, kind: str, blocking: Blocking, frequent: list[str], made: list[DataFrame]
) -> DataFrame:
    """Directed links of one company relation: a newer posting of ``src`` duplicates ``dst``.

    ``units``: distinct (space, t); ``matches``: matching spaces with direction flags;
    ``inner``: the spaces whose own titles must be compared with each other, by default all.
    Of two matching spaces the one with fewer titles visits the other.
    What is read several times is written once, with its size known, and added to ``made``.
    """

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(written(df, f"{name}-{kind}"))
        return made[-1]

    units = kept(units, "units")
    sizes = kept(units.groupBy("space").agg(F.count("*").alias("members")), "sizes")
    a_size = sizes.select(F.col("space").alias("a"), F.col("members").alias("a_n"))
    b_size = sizes.select(F.col("space").alias("b"), F.col("members").alias("b_n"))
    a_visits = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a") < F.col("b")))
    roads = kept(
        matches.join(a_size, "a")
        .join(b_size, "b")
        .select(
            F.when(a_visits, F.col("a")).otherwise(F.col("b")).alias("home"),
            F.when(a_visits, F.col("b")).otherwise(F.col("a")).alias("space"),
            F.when(a_visits, F.col("ab")).otherwise(F.col("ba")).alias("out_ok"),
            F.when(a_visits, F.col("ba")).otherwise(F.col("ab")).alias("in_ok"),
        ),
        "roads",
    )
    visitors = units.withColumnRenamed("space", "home").join(roads, "home")

    def leveled(df: DataFrame) -> DataFrame:
        sized = _on_keys(df.join(sizes, "space"), "space", "t")
        keyed = TITLE.with_keys(sized, "t", blocking.level(F.col("members")), frequent).drop("members")
        return _on_keys(keyed, "space", "_key")

    hosts = units
    if inner is not None:
        hosts = units.join(roads.select("space").union(inner.select("space")).distinct(), "space", "left_semi")
    keyed_hosts = kept(leveled(hosts), "hosts")

    def unit(space: Column, t: Column) -> Column:
        return _unit(kind, space, t)

    first = {"t": "t_a", "_counts": "_counts_a"}
    second = {"t": "t_b", "_counts": "_counts_b"}
    similar_guests = (
        kept(leveled(visitors), "guests")
        .withColumnsRenamed(first)
        .join(keyed_hosts.withColumnsRenamed(second), ["space", "_key"])
        .filter(F.col("t_a") != F.col("t_b"))
        .drop("_key")
    )
    own = keyed_hosts if inner is None else keyed_hosts.join(inner.select("space").distinct(), "space", "left_semi")
    similar_own = (
        own.withColumnsRenamed(first)
        .join(own.withColumnsRenamed(second), ["space", "_key"])
        .filter(F.col("t_a") < F.col("t_b"))
        .drop("_key")
        .withColumns({"home": F.col("space"), "out_ok": F.lit(True), "in_ok": F.lit(True)})
    )
    similar = _both_ratios(similar_guests.unionByName(similar_own), "t_a", "t_b", TITLE)
    same = (
        visitors.join(units, ["space", "t"])
        .select("home", "space", F.col("t").alias("t_a"), F.col("t").alias("t_b"), "out_ok", "in_ok")
        .withColumns({"ab": F.lit(True), "ba": F.lit(True)})
    )
    both = similar.unionByName(same)
    u_a, u_b = unit(F.col("home"), F.col("t_a")), unit(F.col("space"), F.col("t_b"))
    out = F.struct(u_a.alias("src"), u_b.alias("dst"), (F.col("out_ok") & F.col("ab")).alias("ok"))
    back = F.struct(u_b.alias("src"), u_a.alias("dst"), (F.col("in_ok") & F.col("ba")).alias("ok"))
    return both.select(F.inline(F.array(out, back))).filter("ok").select("src", "dst").distinct()


def unit_links(signatures: DataFrame, blocking: Blocking = DEFAULT_BLOCKING) -> DataFrame:
    """All links between units."""
    names, bases = link_parts(signatures, blocking, [])
    return names.unionByName(bases)


def link_parts(signatures: DataFrame, blocking: Blocking, made: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Links between units from company keys, and from company bases; ``made``: the tables they read."""
    by_name = signatures.filter("n <> ''").select(F.col("n").alias("space"), "t").distinct()
    by_base = signatures.filter("b IS NOT NULL").select(F.col("b").alias("space"), "t").distinct()
    # equal bases only matter where the company keys differ
    mixed = (
        signatures.filter("b IS NOT NULL")
        .groupBy(F.col("b").alias("space"))
        .agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
        .filter("lo <> hi OR lo = ''")
    )
    frequent = TITLE.frequent_grams(signatures.select("t").distinct(), "t")
    made += [similar_names(signatures, blocking), contained_bases(signatures)]
    alike, parts = made[-2:]
    names = _links(by_name, alike, None, "n", blocking, frequent, made)
    bases = _links(by_base, parts, mixed, "b", blocking, frequent, made)
    return names, bases


# --- deciding ---------------------------------------------------------------


def signature_table(keyed: DataFrame) -> DataFrame:
    """The newest posting of every (title, company, deadline) signature that can match at all."""
    return (
        keyed.filter("n <> '' OR b IS NOT NULL OR dl <> ''")
        .groupBy("t", "n", "b", "dl")
        .agg(F.min("pos").alias("pos"), F.count("*").alias("copies"))
    )


def _memberships(signatures: DataFrame) -> DataFrame:
    """(unit, pos): the units of every signature."""

    def unit(kind: str, value: str) -> Column:
        return _unit(kind, F.col(value), F.col("t"))

    units = F.array(
        F.when(F.col("dl") != "", unit("d", "dl")),
        F.when(F.col("n") != "", unit("n", "n")),
        F.when(F.col("b").isNotNull(), unit("b", "b")),
    )
    return signatures.select("pos", F.explode(units).alias("unit")).filter("unit IS NOT NULL")


def _reach(kept: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """(unit, pos, lead): for every member the newest kept posting reaching its unit."""
    own = members.join(kept, "pos", "left_semi").select("unit", F.col("pos").alias("lead"))
    linked = own.withColumnRenamed("unit", "src").join(links, "src").select(F.col("dst").alias("unit"), "lead")
    lead = own.unionByName(linked).groupBy("unit").agg(F.min("lead").alias("lead"))
    return members.join(lead, "unit").filter(F.col("lead") < F.col("pos"))


def decide(signatures: DataFrame, links: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(pos, lead) of the removed signatures with the kept posting each one duplicates."""
    members = _memberships(signatures)
    crowded = members.groupBy("unit").agg(F.count("*").alias("c")).filter("c > 1").select("unit")
    linked = links.select(F.explode(F.array("src", "dst")).alias("unit"))
    contested = written(members.join(crowded.union(linked).distinct(), "unit", "left_semi"), "contested")
    members, kept_parts = contested, []
    for _ in range(max_rounds):
        newest = members.groupBy("unit").agg(F.min("pos").alias("newest"))
        incoming = (
            newest.withColumnRenamed("unit", "src")
            .join(links, "src")
            .groupBy(F.col("dst").alias("unit"))
            .agg(F.min("newest").alias("incoming"))
        )
        free = (F.col("newest") == F.col("pos")) & F.coalesce(F.col("incoming") > F.col("pos"), F.lit(True))
        kept = written(
            members.join(newest, "unit")
            .join(incoming, "unit", "left")
            .groupBy("pos")
            .agg(F.bool_and(free).alias("free"))
            .filter("free")
            .select("pos"),
            "kept",
        )
        kept_parts.append(kept)
        removed = _reach(kept, members, links).select("pos")
        left = written(members.join(kept.union(removed).distinct(), "pos", "left_anti"), "undecided")
        if members is not contested:
            dropped(members)
        members = left
        if members.isEmpty():
            break
    else:
        raise RuntimeError(f"undecided postings after {max_rounds} rounds")
    kept = kept_parts[0]
    for part in kept_parts[1:]:
        kept = kept.union(part)
    lost = written(_reach(kept, contested, links).groupBy("pos").agg(F.min("lead").alias("lead")), "lost")
    dropped(contested, members, *kept_parts)
    return lost


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of ``pos`` with their place in it as ``pos``; equal ones have the same."""
    place, row, before, last = TaskContext.get().partitionId() << 33, 0, 0, None
    for batch in batches:
        pos = batch.column("pos")
        if not len(pos):
            continue
        neg, ids = pos.field("neg"), pos.field("id")
        null = ids.is_null()
        same = pc.or_(pc.fill_null(pc.equal(ids[1:], ids[:-1]), False), pc.and_(null[1:], null[:-1]))
        same = pc.and_(same, pc.equal(neg[1:], neg[:-1])).to_numpy(zero_copy_only=False)
        first = (neg[0].as_py(), ids[0].as_py()) == last
        number = np.where(np.concatenate(([first], same)), 0, place + row + np.arange(len(pos)))
        number = np.maximum.accumulate(np.maximum(number, before))
        before, last, row = number[-1], (neg[-1].as_py(), ids[-1].as_py()), row + len(pos)
        columns = [pa.array(number) if c == "pos" else batch.column(c) for c in batch.schema.names]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def _in_order(keyed: DataFrame) -> DataFrame:
    """(id, t, n, b, dl, pos) of the postings that can match at all, ``pos`` as a number."""
    kind = keyed.schema["id"].dataType.simpleString()
    able = written(keyed.filter("n <> '' OR b IS NOT NULL OR dl <> ''").select("id", "t", "n", "b", "dl", "pos"), "postings")
    schema = f"id {kind}, t string, n string, b string, dl string, pos long"
    out = written(able.orderBy("pos").mapInArrow(_places, schema), "postings-in-order")
    dropped(able)
    return out


def duplicate_leaders(active: DataFrame, blocking: Blocking = DEFAULT_BLOCKING) -> DataFrame:
    """(id, leader_id) of every removed posting; ``active`` is a :func:`dedup_scan`.

    Every step is written and removes its shuffle files, so disk holds one step at a time; postings
    are numbered newest first once, and the steps after that carry numbers for them.
    """
    rows = _in_order(with_duplicate_keys(active))
    signatures = written(signature_table(rows), "signatures")
    made = []
    names, bases = [written(part, "links") for part in link_parts(signatures, blocking, made)]
    dropped(*made)
    lost = decide(signatures, names.unionByName(bases))
    dropped(names, bases)
    # a signature with very many copies makes one large partition on the row side only,
    # which AQE splits
    several = signatures.filter("copies > 1").join(lost, "pos", "left").withColumn("lead", F.coalesce("lead", "pos"))
    several = written(several, "several")  # mostly few: its size decides how the postings are joined
    k, v = rows.alias("k"), several.alias("v")
    same = (
        (F.col("k.t") == F.col("v.t"))
        & (F.col("k.n") == F.col("v.n"))
        & F.col("k.b").eqNullSafe(F.col("v.b"))
        & (F.col("k.dl") == F.col("v.dl"))
    )
    ids = rows.groupBy("pos").agg(F.first("id").alias("id"))
    single = signatures.filter("copies = 1").join(lost, "pos").join(ids, "pos").select("id", "lead")
    pairs = k.join(v, same).select("k.id", "v.lead").unionByName(single)
    leaders = pairs.join(ids.select(F.col("pos").alias("lead"), F.col("id").alias("leader_id")), "lead")
    out = written(leaders.filter(F.col("id") != F.col("leader_id")).select("id", "leader_id"), "leaders")
    dropped(rows, signatures, lost, several)
    return out


def survivors(jobs: DataFrame, leaders: DataFrame) -> DataFrame:
    """The table without removed postings."""
    return jobs.join(leaders.select("id"), "id", "left_anti").select(*jobs.columns)


def group_report(active: DataFrame, leaders: DataFrame, top: int | None = 3) -> DataFrame:
    """Duplicate groups, newest leader first: title, company, sources, copies."""
    groups = leaders.unionByName(
        leaders.select(F.col("leader_id").alias("id"), "leader_id").distinct()
    ).join(active.select("id", "source"), "id")
    per_group = groups.groupBy("leader_id").agg(
        F.array_join(F.array_sort(F.collect_set("source")), " + ").alias("sources"),
        F.count("*").alias("copies"),
    )
    out = (
        per_group.join(active.withColumnRenamed("id", "leader_id").drop("source"), "leader_id")
        .orderBy(F.desc("scraped_at"), F.asc("leader_id"))
        .select("leader_id", "title", "company", "sources", "copies")
    )
    return out.limit(top) if top else out


# --- exact rules as a report ------------------------------------------------


def exact_units(keyed: DataFrame) -> DataFrame:
    """Titles shared with the same company key or the same deadline, with their copies."""
    value = F.array(
        F.when(F.col("n") != "", F.struct(F.lit("company").alias("rule"), F.col("n").alias("v"))),
        F.when(F.col("dl") != "", F.struct(F.lit("deadline").alias("rule"), F.col("dl").alias("v"))),
    )
    return (
        keyed.select("t", F.explode(value).alias("u"))
        .filter("u IS NOT NULL")
        .groupBy(F.col("u.rule").alias("rule"), F.col("t").alias("title_key"), F.col("u.v").alias("shared_value"))
        .agg(F.count("*").alias("copies"))
        .filter("copies > 1")
    )


def company_variants(jobs: DataFrame) -> DataFrame:
    """Company keys written in more than one way, with the number of spellings."""
    return (
        jobs.select(company_key("company").alias("company_key"), F.col("company"))
        .filter("company_key <> ''")
        .groupBy("company_key")
        .agg(F.count_distinct("company").alias("spellings"), F.count("*").alias("jobs"))
        .filter("spellings > 1")
    )
