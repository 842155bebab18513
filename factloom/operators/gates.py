"""Admission gates: the first failing check of a candidate decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import calls


def verdict(failed: Column, kind: str, message: str) -> Column:
    """A failed verdict, or null where the check passes."""
    return F.when(
        F.coalesce(failed, F.lit(False)),
        F.struct(F.lit(False).alias("success"), F.array(F.lit(message)).alias("errors"), F.lit(kind).alias("failure_kind")),
    )


def first_failure(*checks: Column) -> Column:
    """The verdict of the first check that fails; success otherwise."""
    fine = F.struct(
        F.lit(True).alias("success"), F.array().cast("array<string>").alias("errors"), F.lit(None).cast("string").alias("failure_kind")
    )
    return F.coalesce(*checks, fine)


def layered_fact_check(answer: Column, unknown_ids: Column, claim: Column, fact: Column) -> Column:
    """Registry, answer shape, refusal, claim shape, then the claimed value against the fact."""
    return first_failure(
        verdict(unknown_ids > 0, "registry", "names ids that don't exist"),
        verdict(answer.isNull() | (F.trim(answer) == ""), "answer_shape", "no answer"),
        verdict(calls.refused(answer), "refusal", "refuses"),
        verdict(claim.isNull(), "claim_shape", "no claim"),
        verdict(~claim.eqNullSafe(fact), "mismatch", "differs from the fact"),
    )


def _comparable(value: Column) -> Column:
    """A VARIANT as text that is equal for equal values: numbers by value, objects and lists as they stand."""
    kind = F.schema_of_variant(value)
    whole = F.try_variant_get(value, "$", "decimal(38,0)")
    number = F.when((kind == "BIGINT") & (F.abs(whole) >= 1 << 53), whole.cast("string")).otherwise(F.try_variant_get(value, "$", "double").cast("string"))
    return (
        F.when(value.isNull() | F.is_variant_null(value), "null")
        .when(kind == "STRING", F.concat(F.lit("s"), F.try_variant_get(value, "$", "string")))
        .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$"), F.concat(F.lit("n"), F.coalesce(number, F.try_variant_get(value, "$", "boolean").cast("double").cast("string"))))
        .otherwise(F.concat(F.lit("o"), F.to_json(value)))
    )


def values_match(expected: Column, actual: Column) -> Column:
    """Whether two VARIANTs are equal; lists as multisets, lists whose elements have no order among them never."""
    listed = lambda v: F.try_variant_get(v, "$", "array<variant>")
    texts = lambda v: F.array_sort(F.transform(listed(v), _comparable))
    first = lambda v: F.transform(texts(v), lambda t: F.when(t.startswith("o["), "l").otherwise(F.substr(t, F.lit(1), F.lit(1))))
    # objects and nulls have no order, nor have texts and numbers among each other
    ordered = lambda v: (F.size(listed(v)) < 2) | (
        (F.size(F.array_distinct(first(v))) == 1) & ~F.array_contains(first(v), "o") & ~F.array_contains(texts(v), "null")
    )
    is_list = F.schema_of_variant(expected).startswith("ARRAY")
    same = F.schema_of_variant(actual).startswith("ARRAY") & ordered(expected) & ordered(actual) & (texts(expected) == texts(actual))
    return F.coalesce(F.when(F.coalesce(is_list, F.lit(False)), same).otherwise(_comparable(expected) == _comparable(actual)), F.lit(False))


def differing_fields(fields: Column, claim: Column) -> Column:
    """Names of the facts' fields (VARIANT object) that a claim (VARIANT object) has otherwise or not at all, in order."""
    as_map = lambda v: F.from_json(F.to_json(v), "map<string,variant>")
    wrong = F.filter(F.map_entries(as_map(fields)), lambda e: ~values_match(e["value"], F.try_element_at(as_map(claim), e["key"])))
    return F.array_sort(F.transform(wrong, lambda e: e["key"]))


# The kinds of failure of a candidate against its fact.
MALFORMED_ANSWER, REFUSAL, MALFORMED_CLAIM, MISMATCH = "malformed_answer", "refusal_answer", "malformed_claim", "fact_mismatch"


def fact_check(candidate: Column, fields: Column, unknown_ids: Column | None = None) -> Column:
    """The verdict on a candidate (VARIANT with ``answer`` and ``structured_claim``) against the fields of its fact (K7).

    Names of ids that the registry doesn't have, then the answer's shape, refusal,
    the claim's shape, and every field.
    """
    answer, claim = F.try_variant_get(candidate, "$.answer", "variant"), F.try_variant_get(candidate, "$.structured_claim", "variant")
    text = F.when(F.schema_of_variant(answer) == "STRING", F.try_variant_get(answer, "$", "string"))
    is_object = F.coalesce(F.schema_of_variant(claim).startswith("OBJECT"), F.lit(False))
    wrong = differing_fields(fields, F.when(is_object, claim))
    mismatch = F.when(
        F.size(wrong) > 0,
        F.struct(
            F.lit(False).alias("success"),
            F.transform(wrong, lambda name: F.concat(F.lit("differs from the fact: "), name)).alias("errors"),
            F.lit(MISMATCH).alias("failure_kind"),
        ),
    )
    return first_failure(
        verdict(unknown_ids > 0, "registry", "names ids that don't exist") if unknown_ids is not None else verdict(F.lit(False), "registry", ""),
        verdict(text.isNull() | (F.trim(text) == ""), MALFORMED_ANSWER, "no answer in words"),
        verdict(calls.refused(text), REFUSAL, "refuses"),
        verdict(~is_object, MALFORMED_CLAIM, "no claim"),
        mismatch,
    )


def judge(answer: Column, consistent: Column, rejects: Column, votes: Column, reference: dict[str, Column]) -> Column:
    """Quality, numbers, consistency, votes, then the three claim shapes against their references.

    A claim check applies only to answers of that shape, and a reference that
    couldn't be looked up counts as unverified, which passes.
    """
    shaped = [
        verdict(calls.claim_shape(answer, kind) & reference[kind].startswith("contradicted"), kind, f"{kind} claim is contradicted")
        for kind in ("mechanism", "capability", "comparative")
    ]
    return first_failure(
        verdict(calls.degenerate(answer), "quality", "says too little"),
        verdict(calls.tick_errors(answer) > 0, "numeric", "ticks and time differ"),
        verdict(~consistent, "consistency", "contradicts itself"),
        verdict(rejects * 2 > votes, "vote", "rejected by the majority"),
        *shaped,
    )
