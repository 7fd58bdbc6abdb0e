"""Tags, containers, lineage, run metrics and policy as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piiloom import rules as R
from piiloom.functions.masking import REDACTED
from piiloom.functions.text import lookup

def tag_array(types: Column, tags: dict | None = None) -> Column:
    """Distinct tags of an array of entity types, sorted; unknown types are ignored."""
    table = R.tag_map() if tags is None else tags
    return F.array_sort(F.array_distinct(F.array_compact(
        F.transform(types, lambda t: lookup(table, t)))))


def doc_tags(jobs: DataFrame) -> DataFrame:
    """One row per document and tag, from the ``tags`` array of each job row."""
    return jobs.select("doc_id", F.explode("tags").alias("tag_fqn"))


def tags_of_entities(entities: DataFrame, tags: dict | None = None) -> DataFrame:
    """The same rows from a bare entity table."""
    table = R.tag_map() if tags is None else tags
    return (entities.select("doc_id", lookup(table, F.col("entity_type")).alias("tag_fqn"))
            .filter("tag_fqn is not null").distinct())


def new_tags(tags: DataFrame, existing: DataFrame) -> DataFrame:
    """Tags a container does not carry yet."""
    return tags.join(existing, ["doc_id", "tag_fqn"], "left_anti")


def tag_hierarchy(jobs: DataFrame, root: str = R.TAG_ROOT) -> DataFrame:
    """Every level of the tag tree in use, with its label and document count.

    Levels are cut out of the dotted names and made distinct within the job
    row, so the only shuffle carries one partial count per level and task.
    """
    def levels(tag):
        parts = F.split(tag, r"\.")
        return F.transform(F.sequence(F.lit(1), F.size(parts)),
                           lambda i: F.array_join(F.slice(parts, 1, i), "."))

    within = F.array_distinct(F.flatten(F.transform("tags", levels)))
    counted = (jobs.select(F.explode(within).alias("tag_fqn"))
               .groupBy("tag_fqn").agg(F.count("*").alias("n_docs")))
    names = {f"{root}.{k}": v[0] for k, v in R.TAG_LABELS.items()} | {root: root}
    texts = {f"{root}.{k}": v[1] for k, v in R.TAG_LABELS.items()}
    parent = F.when(F.col("tag_fqn").contains("."),
                    F.regexp_replace("tag_fqn", r"\.[^.]*$", ""))
    return counted.select("tag_fqn", parent.alias("parent_fqn"),
                          lookup(names, F.col("tag_fqn")).alias("display_name"),
                          lookup(texts, F.col("tag_fqn")).alias("description"), "n_docs")


def file_formats(filename: Column) -> Column:
    """Catalog formats of a file name: a one-element array, or an empty one."""
    ext = F.when(filename.contains("."), F.lower(F.substring_index(filename, ".", -1)))
    return F.array_compact(F.array(lookup(R.FILE_FORMATS, ext)))


def _type_list(types: Column) -> Column:
    return F.when(F.coalesce(F.size(types), F.lit(0)) > 0, F.array_join(types, ", ")
                  ).otherwise(F.lit("none"))


def containers(jobs: DataFrame, redacted: bool, service: str = R.SERVICE_NAME,
               managed_by: str = R.MANAGED_BY) -> DataFrame:
    """Catalog containers of documents (or of their redacted versions).

    ``jobs`` carries the array ``types`` next to the job columns.
    """
    name = F.concat("filename", F.lit(".redacted")) if redacted else F.col("filename")
    score = F.lit(0.0) if redacted else F.coalesce("risk_score", F.lit(0.0))
    band = F.lit("LOW") if redacted else F.coalesce("risk_band", F.lit("LOW"))
    size = F.lit(None).cast("long") if redacted else F.when(
        F.col("file_size") > 0, F.col("file_size"))
    description = F.concat(
        F.lit("[REDACTED VERSION] " if redacted else ""), F.lit("Risk: "), band, F.lit(" ("),
        F.format_string("%.1f", score), F.lit("/100) | PII detected: "),
        _type_list(F.col("types")), F.lit(f" | Managed by {managed_by} | Job: "), F.col("doc_id"))
    return jobs.select(
        "doc_id", F.lit(redacted).alias("is_redacted"), name.alias("name"),
        F.concat(F.lit(service + "."), name).alias("fqn"), size.alias("size"),
        file_formats(F.col("filename")).alias("file_formats"),
        F.col("redacted_key" if redacted else "storage_key").alias("source_key"),
        score.alias("risk_score"), band.alias("risk_band"),
        F.col("types"), description.alias("description"))


def all_containers(jobs: DataFrame, **names) -> DataFrame:
    """Containers of all documents and of every redacted version that exists."""
    done = jobs.filter(F.col("redacted_key").isNotNull())
    return containers(jobs, False, **names).unionByName(containers(done, True, **names))


def risk_properties(containers: DataFrame) -> DataFrame:
    """Custom properties: whole-number score (half to even), band, types, redaction level."""
    return containers.select(
        "fqn", "doc_id", F.bround("risk_score", 0).cast("long").alias("risk_score"), "risk_band",
        _type_list(F.col("types")).alias("detected_pii_types"),
        F.when(F.col("is_redacted"), F.lit("redacted")).otherwise(F.lit("none"))
        .alias("redaction_level"))


def lineage_edges(containers: DataFrame, reports: DataFrame,
                  managed_by: str = R.MANAGED_BY) -> DataFrame:
    """Original -> redacted edges; a document lacking either side has none."""
    source = containers.filter(~F.col("is_redacted")).select("doc_id", F.col("fqn").alias("from_fqn"))
    target = containers.filter("is_redacted").select("doc_id", F.col("fqn").alias("to_fqn"))
    level = reports.select("doc_id", "redaction_level", "timestamp")
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    return (source.join(target, "doc_id").join(level, "doc_id").select(
        "doc_id", "from_fqn", "to_fqn", "redaction_level",
        F.concat(F.lit("Redacted using "), F.col("redaction_level"), F.lit(" strategy at "),
                 stamp, F.lit(f" by {managed_by}")).alias("description")))


def run_state(status: Column) -> Column:
    return (F.when(status == "success", F.lit("success"))
            .when(status == "failed", F.lit("failed")).otherwise(F.lit("partialSuccess")))


def run_metrics(runs: DataFrame) -> DataFrame:
    """Per run: documents that went through, documents that did not, and the state of the whole.

    A run is a success if all its documents are, failed if all of them are, else a partial success.
    """
    state = run_state(F.col("status"))
    ok = F.when(state == "success", 1).otherwise(0)
    lowest, highest = F.min(state), F.max(state)
    return runs.groupBy("run_id").agg(
        F.sum(ok).alias("records"), F.sum(1 - ok).alias("failures"),
        F.when(lowest == highest, lowest).otherwise(F.lit("partialSuccess")).alias("state"),
        F.min("started_at").alias("started_at"), F.max("started_at").alias("ended_at"))


def matching_tags(policy_tags=None) -> Column:
    """The tags of a job row that a policy names (by default, every known tag)."""
    wanted = sorted(set(R.tag_map().values() if policy_tags is None else policy_tags))
    return F.array_intersect("tags", F.array(*[F.lit(t) for t in wanted]))


def policy_match(jobs: DataFrame, policy_tags=None) -> DataFrame:
    """Documents the policy applies to, with the tags that make it apply."""
    found = jobs.select("doc_id", matching_tags(policy_tags).alias("matching_tags"))
    return found.filter(F.size("matching_tags") > 0)


def policy_audit(jobs: DataFrame, ts: Column, policy_tags=None,
                 minimum: float = R.POLICY_SCORE) -> DataFrame:
    """APPLY_POLICY rows for documents at or above the gate, matching or not."""
    gated = jobs.filter(F.col("risk_score") >= F.lit(float(minimum)))
    found = gated.select("doc_id", "entity_fqn", "risk_score",
                         matching_tags(policy_tags).alias("found"))
    return found.select(
        "doc_id", F.lit("APPLY_POLICY").alias("action"), F.lit("system").alias("actor"),
        "entity_fqn", (F.size("found") > 0).alias("policy_will_apply"),
        F.array_join("found", ",").alias("matching_tags"), "risk_score",
        ts.cast("timestamp_ntz").alias("ts"))


def policy_masked_view(redacted: DataFrame) -> DataFrame:
    """What a reader without clearance sees: texts with government IDs only redacted."""
    governed = F.exists("spans", lambda s: s["subtype"] == R.GOVT_ID)
    denied = F.coalesce(governed, F.lit(False))
    return redacted.select("doc_id", denied.alias("masked"), F.when(
        denied, F.coalesce("redacted_text", F.lit(REDACTED))).otherwise(F.col("text"))
        .alias("visible_text"))
