"""What kind of document a text is, and what follows for the status of its rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODIFIED, UNKNOWN = "codified_current_law", "unknown"
# Postures, and the enactment status that each implies for its rules, if it implies one.
EXPECTED = {"codified_current_law": "enacted", "enacted_session_law": "enacted", "pending_bill": "pending", "failed_bill": "failed"}
POSTURES = (*EXPECTED, "bill_status_or_summary_page", "official_explanatory_page", UNKNOWN)


def establish_posture(declared: Column, evidence: Column, evidence_status: Column, has_enactment_date: Column) -> Column:
    """struct(established, basis): a declared posture counts only if its evidence stands in the text; codified law has no enactment date."""

    def out(established: Column | str, basis: str) -> Column:
        return F.struct((established if isinstance(established, Column) else F.lit(established)).alias("established"), F.lit(basis).alias("basis"))

    return (
        F.when(declared.isNull(), out(UNKNOWN, "none declared"))
        .when(~declared.isin(*POSTURES), out(UNKNOWN, "malformed"))
        .when(declared == UNKNOWN, out(UNKNOWN, "declared unknown"))
        .when(evidence.isNull(), out(UNKNOWN, "without evidence"))
        .when(F.coalesce(evidence_status, F.lit("failed")) == "failed", out(UNKNOWN, "evidence not in the text"))
        .when((declared == CODIFIED) & has_enactment_date, out(UNKNOWN, "the text records an enactment date"))
        .otherwise(out(declared, "verified evidence"))
    )
