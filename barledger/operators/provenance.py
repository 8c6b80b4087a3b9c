"""File manifests, artifact profiles and provenance contracts, many sets at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barledger.checks import IntegrityError
from barledger.functions.digest import record_hash, plain_text, set_digest
from barledger.functions.predicates import finite_double, is_sha256
from barledger.operators.dedupe import out_of_order
from barledger.operators.gates import ELIGIBLE_STATUSES, FULL_SCOPE
from barledger.session import materialise

CONTRACT_SCHEMA = "barledger-artifact/v1"
ARTIFACT_KINDS = ("ab_forward_states", "paper_bars")
# Column names containing any of these words are embargoed.
EMBARGOED_WORDS = ("pnl", "profit", "loss", "return", "equity", "sharpe", "drawdown", "performance")
CORE_SIDES = ("CORE_LONG", "CORE_SHORT", "FLAT")


def embargoed_columns(names: Sequence[str]) -> list[str]:
    return sorted(n for n in names if any(w in n.lower() for w in EMBARGOED_WORDS))


def set_root(files: DataFrame, keys: Sequence[str], path: str = "path", sha: str = "sha256") -> DataFrame:
    """One digest per set of (path, sha256) lines, independent of row order.

    Two levels: lines are hashed per leaf (4,096 leaves by the first three hex digits of the
    path's hash), leaves per set, so no task ever collects all files of a large set.
    """
    leaf = F.substring(F.sha2(F.col(path), 256), 1, 3).alias("_leaf")
    leaves = files.groupBy(*keys, leaf).agg(
        set_digest(F.concat_ws(" ", path, sha)).alias("_digest"), F.count("*").alias("_n")
    )
    return leaves.groupBy(*keys).agg(
        set_digest(F.concat_ws(" ", "_leaf", "_digest")).alias("root_sha256"), F.sum("_n").alias("files")
    )


def build_manifest(files: DataFrame, keys: Sequence[str], metadata: Column | None = None) -> DataFrame:
    """Header per run: number of files, set root and self hash; refuses duplicate paths."""
    twice = files.groupBy(*keys, "path").count().filter("count > 1").limit(1).collect()
    if twice:
        raise IntegrityError(f"duplicate manifest path: {twice[0].asDict()}")
    head = set_root(files, keys).withColumn("metadata", F.lit("{}") if metadata is None else metadata)
    return head.withColumn("manifest_sha256", _manifest_hash(keys))


def _manifest_hash(keys: Sequence[str]) -> Column:
    parts = [*keys, "files", "root_sha256", "metadata"]
    return record_hash([plain_text(F.col(p)) for p in parts])


def verify_manifest(header: DataFrame, declared: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, path, problem): a broken self hash, or files that changed, vanished or appeared."""
    self_hash = header.filter(
        ~F.coalesce(F.col("manifest_sha256") == _manifest_hash(keys), F.lit(False))
    ).select(*keys, F.lit(None).cast("string").alias("path"), F.lit("SELF_HASH_MISMATCH").alias("problem"))
    roots = (
        header.select(*keys, F.col("root_sha256").alias("_said"))
        .join(set_root(declared, keys).select(*keys, "root_sha256"), list(keys), "left")
        .filter(~F.coalesce(F.col("_said") == F.col("root_sha256"), F.lit(False)))
        .select(*keys, F.lit(None).cast("string").alias("path"), F.lit("FILE_LIST_MISMATCH").alias("problem"))
    )
    files = compare_files(declared, current, keys).filter(F.col("problem") != "OK").select(*keys, "path", "problem")
    return self_hash.unionByName(roots).unionByName(files)


def compare_files(declared: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Declared against current digests by path."""
    d = declared.select(*keys, "path", F.col("sha256").alias("declared_sha256"))
    c = current.select(*keys, "path", F.col("sha256").alias("current_sha256"))
    problem = (
        F.when(F.col("current_sha256").isNull(), "MISSING")
        .when(F.col("declared_sha256").isNull(), "EXTRA")
        .when(F.lower("declared_sha256") != F.lower("current_sha256"), "MISMATCH")
        .otherwise("OK")
    )
    return d.join(c, [*keys, "path"], "full").withColumn("problem", problem)


def artifact_profile(
    rows: DataFrame, keys: Sequence[str], kind: str, freeze: Column, arrival: str = "src_order"
) -> DataFrame:
    """One row per artifact: rows, extent, and how many rows break each content rule."""
    if kind not in ARTIFACT_KINDS:
        raise IntegrityError(f"unsupported artifact kind: {kind}")
    bad_names = embargoed_columns(rows.columns)
    if bad_names:
        raise IntegrityError(f"performance-like columns are embargoed: {bad_names}")
    ts = F.col("timestamp")
    rules: dict[str, Column] = {"invalid_timestamp": ts.isNull(), "at_or_before_freeze": ts <= freeze}
    if kind == "ab_forward_states":
        for c in ("a_core", "b_core"):
            rules[f"invalid_{c}"] = ~F.coalesce(F.col(c).isin(*CORE_SIDES), F.lit(False))
    else:
        for c in ("open", "close", "target_exposure"):
            rules[f"non_finite_{c}"] = finite_double(F.col(c)).isNull()
        rules["nonpositive_price"] = (finite_double(F.col("open")) <= 0) | (finite_double(F.col("close")) <= 0)
    per_instant = rows.groupBy(*keys, "timestamp").agg(
        F.count("*").alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()]
    )
    facts = per_instant.groupBy(*keys).agg(
        F.sum("n").alias("rows"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
        F.sum(F.when(F.col("timestamp").isNotNull(), F.col("n") - 1).otherwise(0)).alias("duplicate_timestamp"),
        *[F.sum(name).alias(name) for name in rules],
    )
    order = out_of_order(rows.select(*keys, "timestamp", arrival), keys, "timestamp", arrival)
    out = facts.join(order, list(keys))
    checks = ["duplicate_timestamp", "out_of_order", *rules]
    total = sum((F.col(c) for c in checks[1:]), F.col(checks[0]))
    return out.withColumn("acceptable", total == 0)


def gate_problem(kind: Column, freeze: Column) -> Column:
    """First reason a source gate does not allow an artifact, else null."""
    def off(flag: str) -> Column:
        return F.coalesce(F.col(flag) == F.lit(False), F.lit(False))

    states = kind == "ab_forward_states"
    return (
        F.when(~F.coalesce(F.col("gate_status").isin(*ELIGIBLE_STATUSES), F.lit(False)), "GATE_NOT_ELIGIBLE")
        .when(~off("performance_evaluation_allowed"), "GATE_PERFORMANCE_NOT_DISABLED")
        .when(~off("judgement_allowed"), "GATE_JUDGEMENT_NOT_DISABLED")
        .when(~F.coalesce(F.col("gate_freeze") == freeze, F.lit(False)), "GATE_FREEZE_MISMATCH")
        .when(states & ~F.coalesce(F.col("gate_mode") == "full", F.lit(False)), "GATE_MODE_NOT_FULL")
        .when(states & ~F.coalesce(F.col("gate_scope") == FULL_SCOPE, F.lit(False)), "GATE_SCOPE_NOT_COMPLETE")
    )


_SIGNED = (
    "schema", "artifact_kind", "freeze_boundary", "artifact_name", "artifact_sha256", "artifact_bytes",
    "rows", "first_timestamp", "last_timestamp", "columns", "source_snapshot_id", "source_manifest_sha256",
    "gate_sha256", "gate_status", "gate_mode", "gate_scope", "producer_name", "producer_version",
    "producer_code_sha256", "parent_sha256", "performance_embargo_active",
)


def _contract_hash() -> Column:
    return record_hash([plain_text(F.col(c)) for c in _SIGNED])


def build_contracts(facts: DataFrame, freeze: Column) -> DataFrame:
    """One signed contract per artifact row, or ``refused`` with the first reason.

    ``facts`` holds, per artifact: kind, name, digest and bytes of the file, its profile
    (rows, first/last timestamp, columns, acceptable), the source gate and producer ids.
    """
    kind = F.col("artifact_kind")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    refused = (
        F.when(~F.coalesce(kind.isin(*ARTIFACT_KINDS), F.lit(False)), "UNSUPPORTED_KIND")
        .when(blank("source_snapshot_id"), "SNAPSHOT_ID_MISSING")
        .when(blank("producer_name") | blank("producer_version"), "PRODUCER_MISSING")
        .when(~is_sha256(F.lower("producer_code_sha256")), "PRODUCER_DIGEST_INVALID")
        .when(F.col("parent_sha256").isNotNull() & ~is_sha256(F.lower("parent_sha256")), "PARENT_DIGEST_INVALID")
        .when(~F.coalesce(F.col("acceptable") & (F.col("rows") > 0), F.lit(False)), "CONTENT_REFUSED")
        .otherwise(gate_problem(kind, freeze))
    )
    signed = (
        facts.withColumn("refused", refused)
        .withColumn("schema", F.lit(CONTRACT_SCHEMA))
        .withColumn("freeze_boundary", freeze)
        .withColumn("performance_embargo_active", F.lit(True))
        .withColumn("producer_code_sha256", F.lower("producer_code_sha256"))
        .withColumn("parent_sha256", F.lower("parent_sha256"))
    )
    return signed.withColumn("contract_sha256", F.when(F.col("refused").isNull(), _contract_hash()))


def verify_contracts(
    contracts: DataFrame, current: DataFrame, keys: Sequence[str], freeze: Column, parents: DataFrame | None = None
) -> DataFrame:
    """Contracts against recomputed facts: an array of every mismatch per artifact.

    ``parents`` (keys, expected_parent_sha256) states which digest each must build on.
    """
    compared = (
        "artifact_name", "artifact_sha256", "artifact_bytes", "rows", "first_timestamp", "last_timestamp",
        "columns", "source_manifest_sha256", "gate_sha256", "gate_status", "gate_mode", "gate_scope",
    )
    now = current.select(*keys, F.lit(True).alias("_now"), *[F.col(c).alias(f"_now_{c}") for c in compared],
                         *[F.col(c).alias(f"_now_{c}") for c in ("acceptable", "gate_freeze", "performance_evaluation_allowed", "judgement_allowed")])
    both = contracts.join(now, list(keys), "left")
    if parents is not None:
        both = both.join(parents, list(keys), "left")
    else:
        both = both.withColumn("expected_parent_sha256", F.lit(None).cast("string"))
    checks = [
        F.when(~F.coalesce(F.col("contract_sha256") == _contract_hash(), F.lit(False)), "SELF_HASH"),
        F.when(F.col("schema") != CONTRACT_SCHEMA, "SCHEMA"),
        F.when(~F.coalesce(F.col("freeze_boundary") == freeze, F.lit(False)), "FREEZE_BOUNDARY"),
        F.when(~F.col("artifact_kind").isin(*ARTIFACT_KINDS), "KIND"),
        F.when(F.col("_now").isNull(), "ARTIFACT_MISSING"),
        *[F.when(F.col("_now").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_now_{c}")), c.upper()) for c in compared],
        F.when(~F.coalesce(F.col("_now_acceptable"), F.lit(False)), "CONTENT_REFUSED"),
        F.when(~F.coalesce(F.col("_now_gate_freeze") == freeze, F.lit(False)), "GATE_FREEZE"),
        F.when(~F.coalesce(F.col("_now_performance_evaluation_allowed") == F.lit(False), F.lit(False)), "GATE_PERFORMANCE"),
        F.when(~F.coalesce(F.col("_now_judgement_allowed") == F.lit(False), F.lit(False)), "GATE_JUDGEMENT"),
        F.when(~is_sha256(F.col("producer_code_sha256")), "PRODUCER_DIGEST"),
        F.when(F.trim(F.coalesce("source_snapshot_id", F.lit(""))) == "", "SNAPSHOT_ID"),
        F.when(
            F.col("expected_parent_sha256").isNotNull() & ~F.col("parent_sha256").eqNullSafe(F.lower("expected_parent_sha256")),
            "PARENT",
        ),
        F.when(~F.coalesce(F.col("performance_embargo_active"), F.lit(False)), "EMBARGO"),
    ]
    problems = F.array_compact(F.array(*checks))
    return both.select(*keys, problems.alias("problems"), (F.size(problems) == 0).alias("verified"))


def verify_seed(
    contract: DataFrame, declared: DataFrame, current: DataFrame, keys: Sequence[str], freeze: Column
) -> DataFrame:
    """Warm-up seeds: embargo flags, zero evidence rows, the set root, and every file."""
    said = contract.join(
        set_root(declared, keys).select(*keys, F.col("root_sha256").alias("_root")), list(keys), "left"
    )
    off = lambda c: F.coalesce(F.col(c) == F.lit(False), F.lit(False))
    checks = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("status") == "PASS", F.lit(False)), "STATUS"),
            F.when(~F.coalesce(F.col("freeze_inclusive") == freeze, F.lit(False)), "FREEZE_BOUNDARY"),
            F.when(~off("performance_evaluation_allowed"), "PERFORMANCE"),
            F.when(~off("judgement_allowed"), "JUDGEMENT"),
            F.when(~F.coalesce(F.col("evidence_rows") == 0, F.lit(False)), "EVIDENCE_ROWS"),
            F.when(~F.coalesce(F.col("seed_root_sha256") == F.col("_root"), F.lit(False)), "SEED_ROOT"),
        )
    )
    heads = said.select(*keys, F.lit(None).cast("string").alias("path"), F.explode(checks).alias("problem"))
    unsafe = declared.filter(F.array_contains(F.split("path", "/"), "..")).select(*keys, "path", F.lit("UNSAFE_PATH").alias("problem"))
    files = compare_files(declared, current, keys).filter(F.col("problem").isin("MISSING", "MISMATCH")).select(*keys, "path", "problem")
    return heads.unionByName(unsafe).unionByName(files)


def parent_chains(contracts: DataFrame, keys: Sequence[str], digest: str = "contract_sha256", parent: str = "parent_sha256") -> DataFrame:
    """Where each contract's line of parents ends: (keys, digest, depth, end, status).

    OK: the line ends after ``depth`` steps at a contract without a parent, ``end``.
    MISSING_ANCESTOR: it ends at ``end``, which no contract has. CYCLE: it never ends.
    Every round doubles the steps a contract looks ahead, so a line of any length is done
    in the logarithm of it; contracts whose end is known leave the rounds. Digests are
    unique within ``keys``; a repeated one stops the job.
    """
    keys = list(keys)
    known = materialise(contracts.select(*keys, F.lower(digest).alias("_id"), F.lower(parent).alias("_to")), "contracts")
    copies = known.groupBy(*keys, "_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if copies:
        raise IntegrityError(f"two contracts with one digest: {copies[0].asDict()}")
    total = known.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    # _end: where the line is known to end; else _to is 'steps' ahead of _id.
    first = known.alias("a").join(known.select(*keys, F.col("_id").alias("_to"), F.lit(True).alias("_there")), [*keys, "_to"], "left").select(
        *keys, "_id", "_to", F.when(F.col("_to").isNull(), F.lit("OK")).when(F.col("_there").isNull(), F.lit("MISSING_ANCESTOR")).alias("_status"),
        F.when(F.col("_to").isNull(), 0).otherwise(1).cast("bigint").alias("_steps"),
        F.when(F.col("_to").isNull(), F.col("_id")).when(F.col("_there").isNull(), F.col("_to")).alias("_end"))
    ahead = materialise(first, "ahead")
    done, reach = ahead.where("_status is not null"), 1
    while reach <= 2 * total and ahead.where("_status is null").limit(1).collect():
        next_ = ahead.select(*keys, F.col("_id").alias("_to"), F.col("_to").alias("_next"), F.col("_status").alias("_s"), F.col("_steps").alias("_more"), F.col("_end").alias("_e"))
        moved = ahead.where("_status is null").join(next_, [*keys, "_to"]).select(
            *keys, "_id", F.col("_next").alias("_to"), F.col("_s").alias("_status"), (F.col("_steps") + F.col("_more")).alias("_steps"), F.col("_e").alias("_end"))
        ahead = materialise(ahead.where("_status is not null").unionByName(moved), "ahead")
        reach *= 2
    rest = ahead.select(*keys, F.col("_id").alias("digest"), F.when(F.col("_status").isNotNull(), F.col("_steps")).alias("depth"),
                        F.col("_end").alias("end"), F.coalesce("_status", F.lit("CYCLE")).alias("status"))
    return rest


# ---- digest trees -------------------------------------------------------------

TREE_DEPTH = 3


def _leaf(depth: int) -> Column:
    return F.substring(F.sha2(F.col("path"), 256), 1, depth)


def digest_tree(files: DataFrame, keys: Sequence[str], depth: int = TREE_DEPTH) -> DataFrame:
    """(keys, level, node, digest, files): a tree of fan-out 16 over a file set (keys, path, sha256).

    A file belongs to the leaf that the first ``depth`` digits of its path's hash name; a
    node's digest is that of its children's, up to the one root of level 0.
    """
    keys = list(keys)
    line = record_hash([plain_text(F.col("path")), F.lower(plain_text(F.col("sha256")))])
    level = files.groupBy(*keys, _leaf(depth).alias("node")).agg(set_digest(line).alias("digest"), F.count("*").alias("files"))
    tree = None
    for n in range(depth, -1, -1):
        here = level.select(*keys, F.lit(n).alias("level"), "node", "digest", "files")
        tree = here if tree is None else tree.unionByName(here)
        if n:
            level = level.groupBy(*keys, F.substring("node", 1, n - 1).alias("node")).agg(
                set_digest(F.concat_ws("|", "node", "digest")).alias("digest"), F.sum("files").alias("files"))
    return tree


def unlike_leaves(ours: DataFrame, theirs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node) of the leaves in which two stored trees differ; only children of unlike nodes are compared."""
    keys = list(keys)
    depth = ours.unionByName(theirs).agg(F.max("level")).first()[0]
    suspects = None
    for n in range((depth or 0) + 1):
        a, b = (t.where(F.col("level") == n).select(*keys, "node", F.col("digest").alias(d)) for t, d in ((ours, "_a"), (theirs, "_b")))
        if suspects is not None:
            above = suspects.withColumnRenamed("node", "_above")
            a, b = (t.withColumn("_above", F.substring("node", 1, n - 1)).join(above, [*keys, "_above"], "left_semi").drop("_above") for t in (a, b))
        both = a.join(b, [*keys, "node"], "full")
        suspects = materialise(both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys, "node"), "unlike")
    return suspects


def compare_trees(declared: DataFrame, current: DataFrame, declared_tree: DataFrame, current_tree: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``compare_files`` without the files that agree, from files of unlike leaves alone."""
    keys = list(keys)
    depth = declared_tree.unionByName(current_tree).agg(F.max("level")).first()[0] or 0
    leaves = unlike_leaves(declared_tree, current_tree, keys)
    near = lambda files: files.withColumn("node", _leaf(depth)).join(leaves, [*keys, "node"], "left_semi").drop("node")
    return compare_files(near(declared), near(current), keys).where("problem <> 'OK'")
