"""Report texts and items from predictions (sample_id, species, drug, call, confidence, evidence_category,
supporting_features array<struct<gene, mutation, note>>, no_call_reason)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import DISCLAIMER, DRUG_CLASS, DRUG_LOCUS, GENE_TOKEN, STATE_LABEL
from ..functions.scores import display_confidence, sort_key, state_confidence


def look_up(table: dict[str, str], key: Column, default: str) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def percent(p: Column) -> Column:
    return F.concat(F.bround(p * 100, 0).cast("int").cast("string"), F.lit("%"))


def shown(p: Column) -> Column:
    """A percent that is shown is never 0 or 100."""
    return percent(display_confidence(p))


def gene_names(features: Column) -> Column:
    said = F.array_join(F.transform(features, lambda f: F.concat(f["gene"], F.when(f["mutation"].isNotNull(), F.concat(F.lit(" "), f["mutation"])).otherwise(""))), ", ")
    return F.when(F.size(features) > 0, said).otherwise("no supporting genomic features")


def feature_list(features: Column) -> Column:
    said = F.array_join(
        F.transform(features, lambda f: F.concat(f["gene"], F.when(f["mutation"].isNotNull(), F.concat(F.lit(" ("), f["mutation"], F.lit(")"))).otherwise(""), F.when(f["note"].isNotNull(), F.concat(F.lit(" — "), f["note"])).otherwise(""))),
        "; ",
    )
    return F.when(F.size(features) > 0, said).otherwise("no supporting genomic features on record")


def explanation() -> Column:
    """The template's text of each call and evidence."""
    call, evidence, drug, conf = F.col("call"), F.col("evidence_category"), F.col("drug"), shown(F.col("confidence"))
    features = feature_list(F.col("supporting_features"))
    # Texts that readers of the reports rely on.
    return (
        F.when((call == "likely_to_fail") & (evidence == "known_gene_or_mutation"), F.concat(drug, F.lit(": LIKELY TO FAIL against this "), F.col("species"), F.lit(" sample (confidence "), conf, F.lit("). Known resistance mechanism detected: "), features, F.lit(".")))
        .when((call == "likely_to_fail") & (evidence == "statistical_association"), F.concat(drug, F.lit(": LIKELY TO FAIL (confidence "), conf, F.lit("), based on a statistical association with "), features, F.lit(". This is a model-learned pattern, not a confirmed causal resistance mechanism.")))
        .when((call == "likely_to_work") & (evidence == "no_known_signal"), F.concat(drug, F.lit(": LIKELY TO WORK against this "), F.col("species"), F.lit(" sample (confidence "), conf, F.lit("). No resistance signal was found, and the drug's molecular target is present.")))
        .when((call == "likely_to_work") & (evidence == "known_gene_or_mutation"), F.concat(drug, F.lit(": LIKELY TO WORK (confidence "), conf, F.lit("), though note: "), features, F.lit(".")))
        .when(call == "no_call", F.concat(drug, F.lit(": NO CONFIDENT PREDICTION for this sample. Reason: "), F.coalesce("no_call_reason", F.lit("insufficient evidence")), F.lit(".")))
        .when(call == "not_applicable", F.concat(drug, F.lit(": this drug's molecular target was not found in the genome — not applicable to this organism.")))
        .otherwise(F.concat(drug, F.lit(": "), call, F.lit(" (confidence "), conf, F.lit(").")))
    )


def target_marker() -> Column:
    genes = F.transform("supporting_features", lambda f: F.concat(f["gene"], F.when(f["mutation"].isNotNull(), F.concat(F.lit(" "), f["mutation"])).otherwise("")))
    return F.when(F.col("call") == "not_applicable", "N/A").when(F.col("call") == "no_call", "Ambiguous").when(F.size("supporting_features") > 0, F.array_join(F.slice(genes, 1, 3), "; ")).otherwise("None detected")


def bio_text() -> Column:
    """What biology says of a call: a mechanism is named only where a known gene is the evidence."""
    call, drug = F.col("call"), F.col("drug")
    known, none = F.col("evidence_category") == "known_gene_or_mutation", F.col("evidence_category") == "no_known_signal"
    klass, locus, genes = look_up(DRUG_CLASS, drug, "this antibiotic class"), look_up(DRUG_LOCUS, drug, "the drug target"), gene_names(F.col("supporting_features"))
    reason = F.coalesce("no_call_reason", F.lit("the evidence is weak or conflicting"))
    # Texts that readers of the reports rely on.
    return (
        F.when(call == "not_applicable", F.concat(F.lit("The molecular target for "), drug, F.lit(" ("), locus, F.lit(") was not detected in this genome, so susceptibility cannot be assessed from sequence.")))
        .when(call == "no_call", F.concat(F.lit("Evidence for "), drug, F.lit(" is inconclusive, so no confident biological interpretation is made. "), reason))
        .when((call == "likely_to_fail") & known, F.concat(F.lit("Detected a known "), klass, F.lit(" resistance determinant: "), genes, F.lit(". This is an established mechanism, so the drug is predicted to fail.")))
        .when(call == "likely_to_fail", F.concat(F.lit("No confirmed causal resistance mutation at the "), locus, F.lit(" target was detected; the prediction does not rest on a proven mechanism.")))
        .when(none, F.concat(F.lit("No known "), klass, F.lit(" resistance determinant was detected in this genome. (Note: the annotator reports the "), locus, F.lit(" target only when it is altered, so this is absence of a resistance signal, not a confirmed intact target.)")))
        .otherwise(F.concat(F.lit("Although "), genes, F.lit(" was noted, the model still predicts "), drug, F.lit(" works; interpret with caution and confirm by lab testing.")))
    )


def stat_text() -> Column:
    """What the model says of a call: associations are never told as proof."""
    call, genes, conf = F.col("call"), gene_names(F.col("supporting_features")), shown(F.col("confidence"))
    known, none = F.col("evidence_category") == "known_gene_or_mutation", F.col("evidence_category") == "no_known_signal"
    reason = F.coalesce("no_call_reason", F.lit("the evidence is weak or conflicting"))
    # Texts that readers of the reports rely on.
    return (
        F.when(call == "not_applicable", "No probability is reported: the deterministic target gate overrides the statistical model when the drug has no target to act on.")
        .when(call == "no_call", F.concat(F.lit("A safe prediction cannot be computed for this genome. "), reason))
        .when((call == "likely_to_fail") & known, F.concat(F.lit("The calibrated model assigns "), conf, F.lit(" probability of resistance, consistent with the detected determinant.")))
        .when(call == "likely_to_fail", F.concat(F.lit("The model links "), genes, F.lit(" to resistance as a learned statistical pattern (association, not proven cause); calibrated probability "), conf, F.lit(".")))
        .when(none, F.concat(F.lit("Calibrated susceptibility confidence is "), percent(1 - display_confidence(F.col("confidence"))), F.lit("; the genomic profile sits within the susceptible range seen in training.")))
        .otherwise(F.concat(F.lit("Calibrated resistance probability is low ("), conf, F.lit(") despite the noted feature(s).")))
    )


def _item() -> list[Column]:
    """The eight keys of a report item."""
    return [
        F.col("drug"),
        look_up(DRUG_CLASS, F.col("drug"), "Unknown").alias("drug_class"),
        look_up(STATE_LABEL, F.col("call"), "No-call").alias("underlying_state"),
        state_confidence(F.col("call"), F.col("confidence")).alias("confidence"),
        target_marker().alias("target_marker"),
        look_up(DRUG_LOCUS, F.col("drug"), "N/A").alias("locus_id"),
        bio_text().alias("bio_explanation"),
        stat_text().alias("stat_explanation"),
    ]


def items(predictions: DataFrame) -> DataFrame:
    """sample_id and the eight keys of a report item."""
    return predictions.select("sample_id", *_item())


def report_json(predictions: DataFrame) -> DataFrame:
    """sample_id and report: the JSON list of its items in the order in which they are shown (state, then drug)."""
    rows = predictions.select("sample_id", F.struct(sort_key(F.col("call")).alias("k"), "drug", F.struct(*_item()).alias("item")).alias("r"))
    return rows.groupBy("sample_id").agg(F.array_sort(F.collect_list("r")).alias("rs")).select("sample_id", F.to_json(F.transform("rs", lambda r: r["item"])).alias("report"))


def explain(predictions: DataFrame) -> DataFrame:
    """sample_id, drug, explanation_text, disclaimer, confidence_label of each prediction."""
    return predictions.select("sample_id", "drug", explanation().alias("explanation_text"), F.lit(DISCLAIMER).alias("disclaimer"), shown(F.col("confidence")).alias("confidence_label"))


def names_unlisted_gene(text: Column, drug: Column, features: Column) -> Column:
    """Whether a text names a resistance gene that is neither among the supporting ones, nor part of one or the other way."""
    allowed = F.filter(F.concat(F.transform(features, lambda f: F.lower(f["gene"])), F.array(F.lower(look_up(DRUG_LOCUS, drug, "")))), lambda a: a != "")
    tokens = F.transform(F.regexp_extract_all(text, F.lit(GENE_TOKEN), 0), F.lower)
    return F.exists(tokens, lambda t: ~F.exists(allowed, lambda a: F.contains(a, t) | F.contains(t, a)))


def panel_counts(predictions: DataFrame) -> DataFrame:
    """works, fails and holds of each sample."""
    def n(*calls: str) -> Column:
        return F.sum(F.col("call").isin(*calls).cast("long"))

    return predictions.groupBy("sample_id").agg(n("likely_to_work").alias("works"), n("likely_to_fail").alias("fails"), n("no_call", "not_applicable").alias("holds"))


def summary(predictions: DataFrame, order: str = "drug") -> DataFrame:
    """One sentence for each sample, drugs in the given order."""
    def drugs(*calls: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("call").isin(*calls), F.struct(F.col(order), F.col("drug").alias("d")))))
        return F.array_join(F.transform(rows, lambda x: x["d"]), ", ")

    by = predictions.groupBy("sample_id", "species").agg(F.count("*").alias("n"), drugs("likely_to_work").alias("w"), drugs("likely_to_fail").alias("f"), drugs("no_call", "not_applicable").alias("h"))
    bits = F.array(
        F.when(F.col("w") != "", F.concat(F.lit("predicted to remain effective against this "), "species", F.lit(" sample: "), "w")),
        F.when(F.col("f") != "", F.concat(F.lit("predicted to fail (resistance indicated): "), "f")),
        F.when(F.col("h") != "", F.concat(F.lit("no confident call (insufficient or ambiguous evidence): "), "h")),
    )
    # The sentences of the summary.
    tail = ". These are sequence-based predictions and must be confirmed by standard laboratory susceptibility testing before any clinical use."
    body = F.array_join(F.filter(bits, lambda x: x.isNotNull()), "; ")
    return by.select("sample_id", F.concat(F.lit("Across "), F.col("n").cast("string"), F.lit(" antibiotics, "), body, F.lit(tail)).alias("summary"))
