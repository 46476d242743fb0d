"""Access rules, catalogue versions, change detection, audit chains and redaction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from fathom.functions import canonical
from fathom.session import cut, free
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def allowed(rules: DataFrame, subject: str | None, roles: list[str], groups: list[str]) -> DataFrame:
    """Rules that let a principal in: public, or named by user, role or group; no subject is anonymous."""
    overlap = lambda c, values: F.arrays_overlap(F.col(c), F.array(*map(F.lit, values))) if values else F.lit(False)
    named = F.array_contains("users", subject) if subject else F.lit(False)
    return rules.where((F.col("visibility") == "public") | F.coalesce(named, F.lit(False)) | overlap("roles", roles) | overlap("groups", groups))


class VersionConflict(ValueError):
    """Versions of one document take effect at one time."""


def active_versions(versions: DataFrame, cutoff: Column, tie: str | None = None) -> DataFrame:
    """The version in force of each document: the latest of those published or retired by the cutoff; where it
    is retired the document has none. ``tie``: what decides between versions of one time; without it, two versions of the
    latest time are an error, which is found before anything is returned."""
    if tie is None:
        found = versions.where(F.col("status").isin("published", "retired") & (F.col("effective_at") <= cutoff))
        last = found.groupBy("document_id").agg(F.max("effective_at").alias("effective_at"))
        twice = found.join(last, ["document_id", "effective_at"]).groupBy("document_id").count().where("count > 1").orderBy("document_id").limit(5).collect()
        if twice:
            raise VersionConflict("several versions take effect at one time: " + ", ".join(r["document_id"] for r in twice))
        tie = "version"
    past = versions.where(F.col("status").isin("published", "retired") & (F.col("effective_at") <= cutoff))
    last = past.groupBy("document_id").agg(F.max_by(F.struct("version", "status", "effective_at"), F.struct("effective_at", tie)).alias("v"))
    return last.where("v.status = 'published'").select("document_id", "v.version", "v.effective_at")


def version_conflicts(versions: DataFrame) -> DataFrame:
    """Documents with several published or retired versions of one time."""
    return versions.where(F.col("status").isin("published", "retired")).groupBy("document_id", "effective_at").agg(F.count("*").alias("n")).where("n > 1")


def next_activation(versions: DataFrame, cutoff: Column) -> DataFrame:
    return versions.where(F.col("status").isin("published", "retired") & (F.col("effective_at") > cutoff)).agg(F.min("effective_at").alias("next_activation_at"))


def longest_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Each file with the longest root that is a prefix of its path; roots are a short list and are broadcast."""
    both = files.join(F.broadcast(roots), F.col("path").startswith(F.col("root")), "left")
    return both.groupBy(*files.columns).agg(F.max_by("root", F.length("root")).alias("root"))


def status_diff(now: DataFrame, before: DataFrame, key: str, digest: str) -> DataFrame:
    """added, changed, unchanged or removed, for every key of two states."""
    a, b = now.select(key, F.col(digest).alias("_now")), before.select(key, F.col(digest).alias("_before"))
    change = F.when(F.col("_before").isNull(), "added").when(F.col("_now").isNull(), "removed").when(F.col("_now") == F.col("_before"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


ZERO_HASH = "0" * 64


class StaleAnchor(ValueError):
    """Records can't be appended: the log isn't where the anchor says."""


def chain(events: DataFrame, order: list[str], payload: Column, scope: list[str], anchored: DataFrame | None = None) -> DataFrame:
    """Records of audit logs, one chain a scope: sequence, previous_hash (that of the record before; zeros first) and
    record_hash, which covers number, previous hash and payload, so a changed record breaks all behind it.

    ``anchored`` (scope, record_count, last_hash): the logs that these records go on; a scope without anchor begins.
    Every row is a record once, with a null scope, a null order (first) or an order that others have, too (by the
    payload's hash then). A null payload is hashed as an empty text.

    A chain is written in order by nature: a scope is one log, such as a type's log of one day. Rows are dealt by
    scope and sorted, and one task walks a log row by row, holding the hash before and nothing else; what makes it
    fast is many logs, and short appends to long ones. Payloads are hashed before, in all tasks."""
    digest, n, last = free("_digest", events), free("_count", events), free("_last", events)
    rows = events.withColumn(digest, F.sha2(F.coalesce(payload.cast("binary"), F.lit(b"")), 256))
    if anchored is None:
        rows = rows.withColumns({n: F.lit(0).cast("long"), last: F.lit(ZERO_HASH)})
    else:
        heads = anchored.select(*[F.col(c).alias(f"{c}_head") for c in scope], F.col("record_count").cast("long").alias(n), F.col("last_hash").alias(last))
        same = F.lit(True)
        for c in scope:
            same = same & rows[c].eqNullSafe(heads[f"{c}_head"])
        rows = rows.join(heads, same, "left").drop(*[f"{c}_head" for c in scope]).withColumns({n: F.coalesce(n, F.lit(0).cast("long")), last: F.coalesce(last, F.lit(ZERO_HASH))})
    ordered = rows.repartition(*scope).sortWithinPartitions(*scope, *order, digest)
    plain = ordered.toDF(*[f"c{i}" for i in range(len(ordered.columns))])  # names with dots, too
    at = [ordered.columns.index(c) for c in (*scope, digest, n, last)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, number, before = None, 0, ZERO_HASH
        for batch in batches:
            numbers, previous, own = [], [], []
            for *key, hashed, count, head in zip(*[batch.column(i).to_pylist() for i in at], strict=True):
                if key != log:
                    log, number, before = key, count, head
                number += 1
                numbers.append(number)
                previous.append(before)
                before = hashlib.sha256(f"{number}|{before}|{hashed}".encode()).hexdigest()
                own.append(before)
            made = [pa.array(numbers, pa.int64()), pa.array(previous, pa.string()), pa.array(own, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], [*kept, "sequence", "previous_hash", "record_hash"])

    kept = events.columns
    more = [T.StructField("sequence", T.LongType()), T.StructField("previous_hash", T.StringType()), T.StructField("record_hash", T.StringType())]
    return plain.mapInArrow(fold, T.StructType([*events.schema.fields, *more]))


def append(log: DataFrame, anchored: DataFrame, events: DataFrame, order: list[str], payload: Column, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """New records behind those of a log, and the anchors after them; the log itself is left as it is.

    ``anchored`` is what the writer believes to be the logs' ends. For the scopes of ``events`` it must be what the
    log says, or nothing is appended: a log that was cut, or to which another writer has added, raises
    ``StaleAnchor``. Only the ends of these scopes are read."""
    touched = events.select(*scope).distinct()
    keys = [touched[c].eqNullSafe for c in scope]
    of = lambda rows: reduce(lambda a, b: a & b, [k(rows[c]) for k, c in zip(keys, scope, strict=True)])
    ends = lambda rows: rows.join(touched, of(rows), "left_semi").select(*scope, F.col("record_count").cast("long").alias("record_count"), "last_hash")
    believed, there = ends(anchored), ends(anchors(log, scope))
    if not believed.exceptAll(there).unionByName(there.exceptAll(believed)).isEmpty():
        raise StaleAnchor("the log has moved since this anchor was taken")
    new = cut(chain(events, order, payload, scope, believed))
    now = anchors(new, scope).select(*scope, "last_hash", F.lit(1).alias("_new"), "record_count")
    every = anchored.select(*scope, "last_hash", F.lit(0).alias("_new"), "record_count").unionByName(now)
    after = every.groupBy(*scope).agg(F.sum("record_count").cast("long").alias("record_count"), F.max_by("last_hash", "_new").alias("last_hash"))
    return new, after


def anchors(records: DataFrame, scope: list[str]) -> DataFrame:
    """record_count and last_hash of each chain, kept apart from the log, so that a log cut short is noticed."""
    return records.groupBy(*scope).agg(F.count("*").alias("record_count"), F.max_by("record_hash", "sequence").alias("last_hash"))


def verify_chain(records: DataFrame, anchored: DataFrame, payload: Column, scope: list[str]) -> DataFrame:
    """For each scope: records, broken (records whose number, predecessor or hash is wrong) and whether the chain is
    valid, which takes that it is whole to its anchor. All hashes are made again from the payload; a missing log
    or a missing anchor is not valid."""
    w = Window.partitionBy(*scope).orderBy("sequence")
    again = F.sha2(F.concat_ws("|", F.col("sequence").cast("string"), "previous_hash", F.sha2(F.coalesce(payload.cast("binary"), F.lit(b"")), 256)), 256)
    rows = records.select(*scope, "sequence", "previous_hash", "record_hash", again.alias("_again"))
    rows = rows.withColumns({"_n": F.row_number().over(w), "_before": F.coalesce(F.lag("_again").over(w), F.lit(ZERO_HASH))})
    broken = (F.col("sequence") != F.col("_n")) | (F.col("previous_hash") != F.col("_before")) | ~F.col("record_hash").eqNullSafe(F.col("_again"))
    found = rows.groupBy(*scope).agg(F.count("*").alias("records"), F.count_if(broken).alias("broken"), F.max_by("_again", "sequence").alias("_last"))
    ends = anchored.select(*[F.col(c).alias(f"{c}_head") for c in scope], "record_count", "last_hash")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_head")) for c in scope])
    both = found.join(ends, same, "full_outer")
    both = both.select(*[F.coalesce(c, f"{c}_head").alias(c) for c in scope], "records", "broken", "_last", "record_count", "last_hash")
    valid = (F.coalesce("broken", F.lit(0)) == 0) & F.col("record_count").eqNullSafe(F.col("records")) & F.col("last_hash").eqNullSafe(F.col("_last"))
    return both.select(*scope, F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("broken", F.lit(0)).alias("broken"), valid.alias("valid"))


# Parts of the names of keys whose values are never logged.
SENSITIVE = ("api_key", "apikey", "authorization", "content", "body", "password", "prompt", "question", "answer", "secret", "token")


def redacted(details: Column, kind: T.DataType, key: str = "", most: int = 1024) -> Column:
    """Details of any shape (their type is given) with the values of sensitive keys masked, at every depth of
    structs, maps and arrays; other texts are cut to a length. A masked value is a text whatever it was."""
    if any(m in key.lower().replace("-", "_") for m in SENSITIVE):
        return F.lit("[REDACTED]")
    if isinstance(kind, T.StructType):
        return F.struct(*[redacted(details[f.name], f.dataType, f.name, most).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return F.transform(details, lambda x: redacted(x, kind.elementType, "", most))
    if isinstance(kind, T.MapType):
        marked = lambda k: F.replace(F.lower(k), F.lit("-"), F.lit("_")).rlike("|".join(SENSITIVE))
        text = isinstance(kind.valueType, T.StringType)
        value = lambda v: redacted(v, kind.valueType, "", most)
        return F.transform_values(details, lambda k, v: F.when(marked(k), "[REDACTED]").otherwise(value(v) if text else F.to_json(value(v))))
    return F.substring(details, 1, most) if isinstance(kind, T.StringType) else details


def reuse_key(chunk_hash: Column, granularity: Column, fingerprint: Column) -> Column:
    """Under what an embedding can be used again: the chunk's hash, its granularity and what embedded it (null: nothing)."""
    return F.struct(chunk_hash.alias("chunk_hash"), F.coalesce(granularity, F.lit("")).alias("granularity"), F.coalesce(fingerprint, F.lit("")).alias("fingerprint"))


def reuse_join(wanted: DataFrame, sources: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Each distinct key once, with the value of the first source that has it (null: to be made)."""
    out = wanted.select(*keys).distinct()
    for i, s in enumerate(sources):
        s = s.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias(f"_v{i}")).dropDuplicates([f"_{k}" for k in keys])
        match = F.lit(True)
        for k in keys:
            match &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(s, match, "left").drop(*[f"_{k}" for k in keys])
    found = [f"_v{i}" for i in range(len(sources))]
    return out.withColumn(value, F.coalesce(*found)).drop(*found)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old rows and new by key; of rows with one key the last by ``order``. One shuffle, no anti join."""
    every = old.unionByName(new)
    rest = [c for c in every.columns if c not in keys]
    return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def record_approvals(approvals: DataFrame, profiles: DataFrame, generation: str, dataset_fingerprint: str, fixed: bool, at: Column) -> DataFrame:
    """Approvals (generation, fingerprint, profile, dataset_fingerprint, approved_at) after a run: its profiles that passed
    the gate (profile, fingerprint, passed) take the place of what was approved under the same generation and settings.
    Runs on questions that aren't fixed, on no set, or on no generation approve nothing."""
    if not fixed or not dataset_fingerprint or generation in ("", "legacy"):
        return approvals
    new = profiles.where(F.coalesce("passed", F.lit(False))).select(F.lit(generation).alias("generation"), "fingerprint", "profile", F.lit(dataset_fingerprint).alias("dataset_fingerprint"), at.alias("approved_at"))
    last = new.groupBy("generation", "fingerprint").agg(F.max(F.struct("profile", "dataset_fingerprint", "approved_at")).alias("r")).select("generation", "fingerprint", "r.*")
    return approvals.join(last, ["generation", "fingerprint"], "left_anti").select(*last.columns).unionByName(last)


def register_unlisted(files: DataFrame, versions: DataFrame) -> DataFrame:
    """Files without any version, as public first versions, each with a warning of high severity."""
    unlisted = files.join(versions.select("document_id"), "document_id", "left_anti")
    return unlisted.select("document_id", F.lit(1).cast("long").alias("version"), F.lit("public").alias("visibility"), F.lit("high").alias("severity"))


def visible(rows: DataFrame, allowed_ids: DataFrame, document: str = "document_id", other: str | None = None) -> DataFrame:
    """References, paths or edges of documents that a reader may see (``allowed_ids``: document_id); rows that name
    none are left out. ``other``: a column that names the document where the first doesn't."""
    name = F.coalesce(F.nullif(document, F.lit("")), F.col(other)) if other else F.col(document)
    key = free("_document", rows)
    return rows.withColumn(key, name).join(allowed_ids.select(F.col("document_id").alias(key)), key, "left_semi").drop(key)


def reusable(status: Column, same: list[tuple[Column, Column]], chunk_ids: Column) -> Column:
    """Whether a snapshot can be used again: it was finished, everything that made it is the same, and it has chunks."""
    ok = (status == "completed") & (F.size(chunk_ids) > 0)
    for a, b in same:
        ok = ok & a.eqNullSafe(b) & a.isNotNull()
    return F.coalesce(ok, F.lit(False))


def next_state(now: DataFrame, before: DataFrame, key: str, digest: str, at: Column, keep_after: Column) -> DataFrame:
    """One step of change capture: key, digest, change, deleted_at after what is there now met the state before.

    What isn't there any more leaves a tombstone with its time; one from before stays until it is older than
    ``keep_after``; what comes back is added again. Both sides are shuffled by key once."""
    a = now.select(key, F.col(digest).alias("_now"))
    b = before.select(key, F.col(digest).alias("_before"), F.col("deleted_at").alias("_gone"))
    here, alive = F.col("_now").isNotNull(), F.col("_before").isNotNull() & F.col("_gone").isNull()
    change = F.when(here & ~alive, "added").when(here & (F.col("_now") == F.col("_before")), "unchanged").when(here, "changed").when(alive, "removed").otherwise("tombstone")
    rows = a.join(b, key, "full_outer").select(key, F.coalesce("_now", "_before").alias(digest), change.alias("change"), F.when(~here, F.coalesce(F.col("_gone"), at)).alias("deleted_at"))
    return rows.where(F.col("deleted_at").isNull() | (F.col("deleted_at") >= keep_after))


def record_reuse(records: DataFrame, stored: DataFrame, key: str, fields: list[str], fingerprint: str) -> DataFrame:
    """Records with their hash and the vector of a stored one that has the same hash under the same fingerprint
    (null: to be made)."""
    hashed = records.withColumn("record_hash", F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256))
    known = stored.where(F.col("fingerprint") == fingerprint).groupBy("record_hash").agg(F.min_by("vector", key).alias("vector"))
    return hashed.join(known, "record_hash", "left")


def missing_registered(registered: DataFrame, found: DataFrame, cutoff: Column) -> DataFrame:
    """Documents that were registered by themselves before a cutoff and whose file is gone, each with a warning."""
    old = registered.where(F.col("automatic") & (F.col("registered_at") <= cutoff))
    return old.join(found.select("document_id"), "document_id", "left_anti").select("document_id", F.lit("missing_source").alias("warning"))


# -- fingerprints -----------------------------------------------------------------------------------------------------


def permission_fingerprint(rows: DataFrame, subject: Column, roles: Column, groups: Column, revision: Column, generation: Column) -> Column:
    """Hash of who asks, with roles and groups in order, the revision of the rights and the index generation."""
    told = {"generation_id": generation, "subject": subject, "roles": F.array_sort(roles), "groups": F.array_sort(groups), "permission_revision": revision}
    return canonical.fingerprint(rows, *[c.alias(name) for name, c in told.items()], compact=False)


def manifest_revision(rows: DataFrame) -> Column:
    """Hash of a document's entry: document_id, version, status, effective_at, updated_at, path, knowledge_base_id (null
    paths and bases are empty) and acl, with all that these hold."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return canonical.fingerprint(rows, "document_id", "version", "status", "effective_at", "updated_at", text("path"), text("knowledge_base_id"), "acl", compact=False)


def record_hash(rows: DataFrame, document: str, metadata: str) -> Column:
    """Hash of a record's text and metadata (a struct) but for its own hash and the generation."""
    fields = [f.name for f in rows.schema[metadata].dataType.fields if f.name not in ("record_hash", "generation_id")]
    kept = F.struct(*[F.col(metadata).getField(f).alias(f) for f in fields])
    return canonical.fingerprint(rows, F.coalesce(document, F.lit("")).alias("document"), kept.alias("metadata"), compact=False)


# -- rights from elsewhere --------------------------------------------------------------------------------------------


class Refused(PermissionError):
    """An access service's reply can't be trusted, so nothing is allowed."""


def permitted(reply: DataFrame, revision: str | None, wanted_revision: str, documents: DataFrame | None = None) -> DataFrame:
    """document_id, once each, that an access service allows (``reply``: document_id).

    The reply must be of the revision that was asked for, without blank ids, and of documents that the index has
    (``documents``: document_id; none: not known). Anything else is refused as a whole, before anything is read with it."""
    if (revision or "") != wanted_revision:
        raise Refused("the rights are of another revision")
    ids = reply.select("document_id")
    if not ids.where(F.col("document_id").isNull() | (F.col("document_id") == "")).isEmpty():
        raise Refused("the reply has blank documents")
    if documents is not None and not ids.join(documents.select("document_id"), "document_id", "left_anti").isEmpty():
        raise Refused("the reply has documents that the index doesn't have")
    return ids.distinct()
