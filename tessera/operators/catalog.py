"""Catalog life cycle: diffs, class maps, tiered matching, duplicates, audit, promotion."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import hamming64
from tessera.functions.text import holds_secret, normalize_label, stable_id
from tessera.operators.numbering import number_rows, saved
from tessera.operators.rules import PLACEHOLDERS

#: Labels that are no item slots (fixed values; compared after label normalisation).
NON_SLOT_LABELS = (
    "Active - Conceal",
    "Allow Throw",
    "Bloody Retribution",
    "Broken Heart",
    "Flame Retribution",
    "Ice Retribution",
    "Magic Potion",
    "Passive - Dire Hit",
    "Passive - Encourage",
    "Passive - Favor",
    "Power Potion",
    "Resonating Heart",
    "Rock Potion",
    "Throw Forbidden",
)
NON_SLOT_NAMES = tuple(" ".join(w for w in name.lower().split() if w != "-") for name in NON_SLOT_LABELS)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, name: str, visual: str) -> DataFrame:
    """One row per identity of either snapshot: added, removed, renamed, visual_changed, unchanged."""
    o = old.select(F.col(key).alias("_ok"), F.col(name).alias("old_name"), F.col(visual).alias("_ov"))
    n = new.select(F.col(key).alias("_nk"), F.col(name).alias("new_name"), F.col(visual).alias("_nv"))
    both = o.join(n, F.col("_ok") == F.col("_nk"), "full_outer")
    change = F.when(F.col("_ok").isNull(), "added").when(F.col("_nk").isNull(), "removed").when(~F.col("old_name").eqNullSafe(F.col("new_name")), "renamed").when(~F.col("_ov").eqNullSafe(F.col("_nv")), "visual_changed").otherwise("unchanged")
    return both.select(F.coalesce("_ok", "_nk").alias(key), "old_name", "new_name", change.alias("change"))


def assign_ids(candidates: DataFrame, order: Sequence[str]) -> DataFrame:
    """stable_id of every candidate (kind, adapter, identity, name); of equal ids the second
    and later ones in order have ``_2``, ``_3``, ... (F20)."""
    based = candidates.withColumn("_base", stable_id(F.col("kind"), F.col("adapter"), F.col("identity"), F.col("name")))
    k = F.row_number().over(Window.partitionBy("_base").orderBy(*order))
    return based.withColumn("_k", k).withColumn("stable_id", F.concat("_base", F.when(F.col("_k") > 1, F.concat(F.lit("_"), "_k")).otherwise(""))).drop("_base", "_k")


def class_numbers(ids: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Contiguous numbers from 0: survivors in their previous order, then new ids by name.

    Numbered by sorted ranges, each in its own task.
    """
    prev = previous.select(F.col(key), F.col("index").alias("_prev"))
    rows = ids.select(key).distinct().join(prev, key, "left").withColumn("_new", F.col("_prev").isNull())
    return number_rows(rows, ["_new", "_prev", key], "index").select(key, F.col("_prev").alias("previous_index"), F.col("index").cast("int").alias("index"))


def tiered_match(candidates: DataFrame, previous: DataFrame, candidate: str, tiers: Sequence[tuple[Column, Column]], identity: str) -> DataFrame:
    """Matches by the first tier that gives any.

    tiers: (candidate key, previous key) expressions in order.  Gives tier (from 1) and
    the sorted set of identities; more than one is ambiguous, none is new.
    """
    found = None
    for k, (left, right) in enumerate(tiers, 1):
        c = candidates.select(F.col(candidate).alias("_c"), left.alias("_k")).where("_k is not null")
        p = previous.select(F.col(identity).alias("_id"), right.alias("_k")).where("_k is not null").distinct()
        hit = c.join(p, "_k").select("_c", F.lit(k).alias("tier"), "_id")
        found = hit if found is None else found.unionByName(hit)
    # Grouped by tier and minimum, without a window over a candidate's matches.
    by = found.groupBy("_c", "tier").agg(F.array_sort(F.collect_set("_id")).alias("_ids"))
    first = by.groupBy("_c").agg(F.min_by(F.struct("tier", "_ids"), "tier").alias("_m")).select("_c", "_m.*")
    out = candidates.select(F.col(candidate).alias("_c")).join(first, "_c", "left")
    status = F.when(F.col("tier").isNull(), "new").when(F.size("_ids") > 1, "ambiguous").otherwise("matched")
    return out.select(F.col("_c").alias(candidate), "tier", F.coalesce(F.size("_ids"), F.lit(0)).alias("n_matches"), F.when(F.size("_ids") == 1, F.col("_ids")[0]).alias("matched_id"), status.alias("status"))


def exact_duplicates(df: DataFrame, key: str, digest: str, group: str) -> DataFrame:
    """Digests that more than one class has, with counts and the smallest member."""
    return df.groupBy(digest).agg(F.count("*").alias("members"), F.countDistinct(group).alias("classes"), F.min(key).alias("first_member")).where("classes > 1")


def by_shuffle(side: DataFrame) -> DataFrame:
    """side, to be joined where the keys meet, never by a broadcast.

    Spark broadcasts what it takes to be below the session's threshold, from the size of the
    files: a million rows of a well-compressed table count as a few MB there and as hundreds
    in the driver.  For sides that grow with the data.
    """
    return side.hint("merge")


#: A row sent to a join costs as much as so many pairs that are compared there; choices of blocks at most.
ROW_COST, CHOICES = 20, 256


def agreement_blocks(n: int, ones: Sequence[int], distance: int) -> list[int]:
    """The 64 bits as masks of blocks, of which pairs within the distance differ in ``distance`` at most.

    n hashes, of which ones[k] have bit k.  A bit counts by how seldom two hashes differ in
    it, and the blocks get equal shares of all bits' weight.  More blocks make more choices of
    those that agree, of more bits each: their number is the one with the least work.
    """
    weight = [-math.log2((c / n) ** 2 + (1 - c / n) ** 2) if n else 1.0 for c in ones]
    work = {}
    for blocks in range(distance + 1, 31):
        choices = math.comb(blocks, distance)
        if choices <= max(CHOICES, distance + 1):
            work[blocks] = choices * n * (ROW_COST + n / 2 / 2 ** (sum(weight) * (blocks - distance) / blocks))
    held = [[0.0, 0, k] for k in range(min(work, key=lambda k: (work[k], k)))]  # weight, mask, block
    for k in sorted(range(64), key=lambda k: -weight[k]):
        least = min(held, key=lambda h: (h[0], h[1].bit_count(), h[2]))
        least[0] += weight[k]
        least[1] |= 1 << k
    return [mask for _, mask, _ in held]


def near_hashes(hashes: DataFrame, distance: int) -> DataFrame:
    """_l, _r, distance: each pair of the distinct 64-bit hashes _x (a saved table) that differ
    in at most ``distance`` bits, once, _l being the less.

    The bits are cut into B blocks (``agreement_blocks``); a pair within the distance agrees
    on B - distance of them at least (pigeonhole), so an equi-join on (choice of so many
    blocks, their bits) finds every pair, and the distance is verified.  A pair is given by
    its first choice only: the blocks it agrees on up to the choice's last are the choice.
    """
    long = lambda mask: F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")
    count = hashes.agg(F.count("*"), *[F.sum(F.shiftrightunsigned("_x", k).bitwiseAND(F.lit(1).cast("long"))) for k in range(64)]).first()
    masks = agreement_blocks(count[0], [c or 0 for c in count[1:]], distance)
    choices = [(sum(1 << j for j in c), sum(masks[j] for j in c)) for c in combinations(range(len(masks)), len(masks) - distance)]
    cut = F.explode(F.array(*[F.struct(F.lit(c).alias("choice"), F.col("_x").bitwiseAND(long(m)).alias("value")) for c, m in choices]))
    rows = hashes.select("_x", cut.alias("_b")).select("_x", "_b.*")
    pairs = rows.withColumnRenamed("_x", "_l").join(by_shuffle(rows.withColumnRenamed("_x", "_r")), ["choice", "value"])
    differ = F.col("_l").bitwiseXOR(F.col("_r"))
    agreed = F.lit(0)
    for j, m in enumerate(masks):
        agreed = agreed + F.when(differ.bitwiseAND(long(m)) == 0, 1 << j).otherwise(0)
    rest = agreed.bitwiseXOR(F.col("choice"))
    first = (rest == 0) | (rest.bitwiseAND(-rest) > F.col("choice"))
    return pairs.where((F.col("_l") < F.col("_r")) & (hamming64(F.col("_l"), F.col("_r")) <= distance) & first).select("_l", "_r", hamming64(F.col("_l"), F.col("_r")).alias("distance"))


def near_duplicates(df: DataFrame, key: str, bits: str, distance: int = 4, content: str | None = None) -> DataFrame:
    """Pairs of rows of different content whose 64-bit hashes differ in at most ``distance`` bits.

    Content is the column ``content``, equal hashes of different content being pairs of
    distance 0, or else the hash.  Distinct hashes are compared once (``near_hashes``); rows
    of one hash and content are a class, and the pairs of classes are given for each of them.
    """
    own = saved(df.where(F.col(bits).isNotNull()).select(F.col(key).alias("_id"), F.col(bits).cast("long").alias("_x"), F.col(content or bits).alias("_s")), "near")
    hashes = saved(own.select("_x").distinct(), "hashes")
    links = near_hashes(hashes, distance)
    if content:
        links = links.unionByName(hashes.select(F.col("_x").alias("_l"), F.col("_x").alias("_r"), F.lit(0).alias("distance")))
    classes = own.select("_x", "_s").distinct()
    left, right = classes.select(F.col("_x").alias("_l"), F.col("_s").alias("_ls")), classes.select(F.col("_x").alias("_r"), F.col("_s").alias("_rs"))
    pairs = links.join(by_shuffle(left), "_l").join(by_shuffle(right), "_r").where(~F.col("_ls").eqNullSafe(F.col("_rs")))
    pairs = pairs.where((F.col("_l") < F.col("_r")) | (F.col("_ls").isNull() & F.col("_rs").isNotNull()) | (F.col("_ls") < F.col("_rs")))
    for side, of, member in (("_l", "_ls", "_a"), ("_r", "_rs", "_z")):
        members = own.select(F.col("_id").alias(member), F.col("_x").alias("_mx"), F.col("_s").alias("_ms"))
        pairs = pairs.join(by_shuffle(members), (F.col(side) == F.col("_mx")) & F.col(of).eqNullSafe(F.col("_ms"))).drop("_mx", "_ms")
    return pairs.where("_a <> _z").select(F.least("_a", "_z").alias("left_id"), F.greatest("_a", "_z").alias("right_id"), "distance")


def latest(ledger: DataFrame, keys: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """The last action of each key, as a grouped maximum."""
    rest = [c for c in ledger.columns if c not in keys]
    return ledger.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*sequence)).alias("_l")).select(*keys, "_l.*")


def apply_review(visuals: DataFrame, ledger: DataFrame, entity: str, visual: str, sequence: Sequence[str]) -> DataFrame:
    """Each visual with its own last action, else its class's."""
    own = latest(ledger.where(F.col(visual).isNotNull()), [entity, visual], sequence).select(entity, visual, F.col("action").alias("_va"))
    whole = latest(ledger.where(F.col(visual).isNull()).drop(visual), [entity], sequence).select(entity, F.col("action").alias("_ca"))
    return visuals.join(own, [entity, visual], "left").join(whole, entity, "left").withColumn("action", F.coalesce("_va", "_ca")).drop("_va", "_ca")


def rejected_actions(ledger: DataFrame, entities: DataFrame, visuals: DataFrame, entity: str, visual: str) -> DataFrame:
    """Actions on unknown classes, or on visuals of another class."""
    known = ledger.join(entities.select(entity).distinct(), entity, "left_anti").withColumn("reason", F.lit("unknown_class"))
    rest = ledger.join(entities.select(entity).distinct(), entity, "left_semi").where(F.col(visual).isNotNull())
    return known.unionByName(rest.join(visuals.select(entity, visual).distinct(), [entity, visual], "left_anti").withColumn("reason", F.lit("visual_of_other_class")))


def ambiguous_identities(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source identities that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def label_index(names: DataFrame, key: str, name: Column, aliases: Column, normal, order: str) -> DataFrame:
    """Normalised label -> id over names and aliases; later rows overwrite earlier ones."""
    labels = names.select(F.col(key), F.col(order), F.explode(F.array_distinct(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))))).alias("_l"))
    return labels.groupBy(normal(F.col("_l")).alias("label")).agg(F.max_by(key, order).alias(key), F.countDistinct(key).alias("n_ids"))


def compatibility(runtime: DataFrame, model: DataFrame, visuals: DataFrame, key: str) -> DataFrame:
    """Counts of runtime ids without a model class, model ids without a runtime class, and
    observed visuals without either; compatible if all are 0 (J9, U3)."""
    def gone(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")

    rows = gone(runtime, model, "runtime_not_in_model").unionByName(gone(model, runtime, "model_not_in_runtime")).unionByName(gone(visuals, runtime, "visual_not_in_runtime"))
    return rows.withColumn("compatible", F.col("n") == 0)


def audit(rules: Sequence[tuple[str, str, DataFrame, Column]]) -> DataFrame:
    """Issues of all rules: (code, severity, rows, subject)."""
    out = None
    for code, severity, rows, subject in rules:
        one = rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), subject.cast("string").alias("subject"))
        out = one if out is None else out.unionByName(one)
    return out


def promotion(issues: DataFrame) -> DataFrame:
    """Counts of mandatory issues and warnings; ready without mandatory ones."""
    return issues.agg(F.count_if(F.col("severity") == "mandatory").alias("mandatory"), F.count_if(F.col("severity") == "warning").alias("warnings")).withColumn("promotion_ready", F.col("mandatory") == 0)


def carry_forward(previous: DataFrame, files: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """Previous visuals whose bytes still have the recorded digest, and the others."""
    now = files.select(key, F.col(digest).alias("_now"))
    joined = previous.join(now, key, "left")
    same = F.col(digest).eqNullSafe(F.col("_now"))
    reason = F.when(F.col("_now").isNull(), "missing").otherwise("digest_changed")
    return joined.where(same).drop("_now"), joined.where(~same).withColumn("reason", reason).drop("_now")


def merged_aliases(previous: Column, new: Column, old_name: Column, renamed: Column) -> Column:
    """Aliases without repeats in first order; the old name joins on a rename."""
    return F.array_distinct(F.concat(previous, new, F.when(renamed, F.array(old_name)).otherwise(F.array().cast("array<string>"))))


def record_status(is_new: Column, changed: Column, previous: Column) -> Column:
    """Review status of a rebuilt record."""
    return F.when(is_new, "unreviewed").when(changed, "changes_pending").otherwise(previous)


def merge_first_wins(parts: Sequence[DataFrame], digest: str, label: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Manifests as one, first of each digest wins and is renumbered; and digests whose
    labels disagree, which are errors (U6)."""
    whole = None
    for k, p in enumerate(parts):
        one = p.withColumn("parent", F.lit(k))
        whole = one if whole is None else whole.unionByName(one)
    rest = [c for c in whole.columns if c != digest]
    merged = whole.groupBy(digest).agg(F.min_by(F.struct(*rest), F.struct("parent", order)).alias("_f")).select(digest, "_f.*")
    clash = whole.groupBy(digest).agg(F.countDistinct(label).alias("labels")).where("labels > 1")
    return merged, clash


def missing_island(ids: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """The first id after which ``limit`` consecutive ids are absent.

    Ids are dealt to blocks of ``limit`` numbers: inside a block no gap is that wide, and the
    id after a block's last is the first of the next block, so one equality join decides.
    """
    blocks = ids.where(F.col(key).isNotNull()).groupBy(F.floor(F.col(key) / limit).alias("_b")).agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    after = blocks.select((F.col("_b") - 1).alias("_b"), F.col("_first").alias("_next"))
    return blocks.join(after, "_b", "left").where((F.col("_next") - F.col("_last") > limit) | F.col("_next").isNull()).agg(F.min("_last").alias("stops_after"))


#: Codes of an audit by severity.
MANDATORY_CODES = ("placeholder_record", "unreviewed_class", "unreviewed_visual", "unverified_provenance", "missing_or_invalid_asset", "sha256_mismatch", "phash_mismatch", "dimension_mismatch", "mime_mismatch", "conflicting_normalized_label", "exact_duplicate", "secret_pattern")
WARNING_CODES = ("unexpected_aspect_ratio", "near_duplicate")


def audit_catalog(entities: DataFrame, visuals: DataFrame, assets: DataFrame, manifest: DataFrame) -> DataFrame:
    """All issues of a catalog snapshot (C6): severity, code, class_id, visual_id, related.

    entities: id, kind, canonical_name, review_status; visuals: id, entity_id, asset_path,
    review_status, provenance_status, sha256, phash, width, height, mime_type; assets: what
    the files hold now (asset_path, sha256, phash, width, height, mime_type; null sha256:
    not an image); manifest: text, lines of the snapshot's file.

    Mismatches come from one join of visuals with files, labels and digests from one
    grouping each, near duplicates from the join by agreeing blocks of bits; related ids are joined in order.
    """
    none = F.lit(None).cast("string")

    def issue(rows: DataFrame, code: str, class_id: Column = none, visual: Column = none, related: Column = none) -> DataFrame:
        severity = "mandatory" if code in MANDATORY_CODES else "warning"
        return rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), class_id.cast("string").alias("class_id"), visual.cast("string").alias("visual_id"), related.cast("string").alias("related"))

    label = normalize_label(F.col("canonical_name"))
    named = entities.withColumn("_label", label)
    now = assets.select("asset_path", *[F.col(c).alias(f"_{c}") for c in ("sha256", "phash", "width", "height", "mime_type")])
    both = visuals.join(by_shuffle(now), "asset_path", "left")
    bad = F.col("_sha256").isNull()
    ratio = F.col("_width") / F.col("_height")
    tests = F.array(*[F.when(test, code) for code, test in (
        ("unreviewed_visual", F.col("review_status") != "approved"), ("unverified_provenance", F.col("provenance_status") != "verified"), ("missing_or_invalid_asset", bad),
        ("sha256_mismatch", F.col("sha256") != F.col("_sha256")), ("phash_mismatch", ~bad & (F.col("phash") != F.col("_phash"))),
        ("dimension_mismatch", ~bad & ((F.col("width") != F.col("_width")) | (F.col("height") != F.col("_height")))), ("mime_mismatch", ~bad & (F.col("mime_type") != F.col("_mime_type"))), ("unexpected_aspect_ratio", ~bad & ((ratio < 0.5) | (ratio > 2.0))),
    )])
    faults = both.select("entity_id", "id", F.explode(F.array_compact(tests)).alias("code"))
    faults = faults.select(F.when(F.col("code").isin(*WARNING_CODES), "warning").otherwise("mandatory").alias("severity"), "code", F.col("entity_id").cast("string").alias("class_id"), F.col("id").cast("string").alias("visual_id"), none.alias("related"))
    good = both.where(~bad).select("entity_id", "id", F.col("_sha256").alias("sha"), F.col("_phash").alias("bits"))
    ids = lambda c: F.array_join(F.array_sort(F.collect_list(F.col(c).cast("string"))), ",")
    clash = named.where("_label <> ''").groupBy("kind", "_label").agg(F.count("*").alias("n"), ids("id").alias("ids")).where("n > 1")
    same = good.groupBy("sha").agg(F.countDistinct("entity_id").alias("n"), ids("id").alias("ids")).where("n > 1")
    classes = good.select(F.col("id").alias("_vid"), "entity_id")
    pairs = near_duplicates(good, "id", "bits", 4, "sha")
    left, right = pairs.columns[:2]
    for side, of in ((left, "_ca"), (right, "_cb")):
        pairs = pairs.join(by_shuffle(classes.withColumnRenamed("entity_id", of)), F.col(side) == F.col("_vid")).drop("_vid")
    pairs = pairs.where("_ca <> _cb")
    secret = manifest.where(holds_secret(F.col("text"))).limit(1)
    found = [
        issue(named.where(F.col("_label").isin(*PLACEHOLDERS)), "placeholder_record", F.col("id")), issue(named.where("review_status <> 'approved'"), "unreviewed_class", F.col("id")),
        issue(clash, "conflicting_normalized_label", related=F.col("ids")), issue(same, "exact_duplicate", related=F.col("ids")),
        issue(pairs, "near_duplicate", related=F.array_join(F.array_sort(F.array(F.col(left).cast("string"), F.col(right).cast("string"))), ",")), issue(secret, "secret_pattern"),
    ]
    for one in found:
        faults = faults.unionByName(one)
    return faults
