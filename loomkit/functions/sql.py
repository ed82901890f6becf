"""The column builders as functions for Spark SQL: temporary SQL functions of a session, which the optimizer puts in line."""

from __future__ import annotations

from pyspark.sql import SparkSession

from loomkit.config import LabelSet
from loomkit.functions.normalize import QUOTED_LABEL


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def functions(labels: LabelSet) -> dict[str, str]:
    """Signature and result of each function, and the expression that it stands for, by name."""
    lookup = ", ".join(f"{_text(x.lower())}, {_text(x)}" for x in labels.labels)
    at = lambda x: f"instr(lower(raw), {_text(x.lower())})"
    mentions = ", ".join(f"if({at(x)} > 0, struct({at(x)} AS at, {-len(x)} AS size, {_text(x)} AS name), NULL)" for x in labels.labels)
    object_ = r"if(contains(raw, '{'), regexp_extract(raw, '(?s)(\\{.*\\})', 1), NULL)"
    found = (
        f"coalesce(known_label(get_json_object({object_}, '$.label')), known_label(if(contains(raw, '\"label\"'), nullif(regexp_extract(raw, {_text(QUOTED_LABEL)}, 1), ''), NULL)), "
        f"least({mentions}, NULL).name)"
    )
    return {
        "known_label": f"(raw STRING) RETURNS STRING RETURN coalesce(try_element_at(map({lookup}), lower(trim(raw))), try_element_at(map({lookup}), lower(trim(regexp_replace(raw, '\\\\s+', ' ')))))",
        "found_label": f"(raw STRING) RETURNS STRING RETURN {found}",
        "single_label": f"(raw STRING) RETURNS STRUCT<label: STRING, parsed_ok: BOOLEAN> RETURN named_struct('label', coalesce(found_label(raw), {_text(labels.default)}), 'parsed_ok', found_label(raw) IS NOT NULL)",
        "is_minority": f"(label STRING) RETURNS BOOLEAN RETURN label <> {_text(labels.default)}",
        "rarest_label": f"(types ARRAY<STRING>, counts MAP<STRING, BIGINT>) RETURNS STRING RETURN coalesce(array_min(transform(types, (t, i) -> struct(coalesce(try_element_at(counts, t), 0L) AS n, i AS i, t AS t))).t, {_text(labels.default)})",
        "soft_bottleneck": "(losses ARRAY<DOUBLE>, beta DOUBLE) RETURNS DOUBLE RETURN CASE WHEN size(losses) = 0 THEN NULL "
        "WHEN beta = 0 THEN aggregate(losses, 0D, (a, x) -> a + x) / size(losses) "
        "ELSE transform(array(array_max(losses)), m -> m + ln(aggregate(losses, 0D, (a, x) -> a + exp(beta * (x - m))) / size(losses)) / beta)[0] END",
    }


def register(spark: SparkSession, labels: LabelSet) -> list[str]:
    """Makes the functions known to the session, over any of the same name, and gives their names.

    known_label(raw), found_label(raw), single_label(raw): the label that a text spells, or names, or names with the
    default in its place; is_minority(label); rarest_label(types, counts); soft_bottleneck(losses, beta), null without losses.
    """
    made = functions(labels)
    for name, rest in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{rest}")
    return list(made)
