"""Checks of written answers against the evidence they were given.

`responses` has `response` (text) and `evidence` (array of the numbers supplied).
"""

from pyspark.sql import Column, DataFrame, functions as F

# Headings, phrases and the number pattern.
SECTIONS = ["SEVERITY", "EVIDENCE", "INTERPRETATION", "NEXT CHECKS"]
FORBIDDEN = [
    "there is congestion",
    "network congestion is occurring",
    "congestion is occurring",
    "congestion has occurred",
    "experiencing congestion",
    "indicates congestion",
    "indicating congestion",
]
INSUFFICIENT = "insufficient evidence"
NUMBER = r"(?<![A-Za-z0-9])[-+]?\d+(?:\.\d+)?%?"
NO_SECTION = "EVIDENCE section missing"


def has_sections(text: Column) -> Column:
    return F.forall(F.array(*[F.lit(s) for s in SECTIONS]), lambda s: F.contains(text, s))


def evidence_section(text: Column) -> Column:
    """From the first EVIDENCE to the next INTERPRETATION; NULL when there is none."""
    at = F.locate("EVIDENCE", text) if isinstance(text, str) else F.instr(text, "EVIDENCE")
    after = F.substr(text, at + len("EVIDENCE"))
    return F.when(at > 0, F.substring_index(after, "INTERPRETATION", 1))


def _unsupported(token: Column, evidence: Column) -> Column:
    percent = F.endswith(token, F.lit("%"))
    plain = F.rtrim(token, F.lit("%"))
    value = plain.try_cast("double")
    numbering = (
        (value == F.floor(value)) & value.between(1, 20) & ~F.contains(plain, F.lit(".")) & ~percent
    )

    def matches(given):
        scaled = given * 100
        as_percent = F.abs(value - scaled) <= F.greatest(F.lit(0.1), F.abs(scaled) * 0.02)
        as_number = F.abs(value - given) <= F.greatest(F.lit(0.01), F.abs(given) * 0.02)
        return (percent & as_percent) | as_number

    return ~numbering & ~F.exists(evidence, matches)


def unsupported_numbers(text: Column, evidence: Column) -> Column:
    """Sorted distinct numbers of the evidence section that no supplied number backs.

    Within 2 % or 0.01; a percentage also within 2 % or 0.1 of a hundredfold. Whole
    numbers 1 to 20 count as list numbering.
    """
    tokens = F.regexp_extract_all(evidence_section(text), F.lit(NUMBER), F.lit(0))
    given = F.filter(evidence, lambda e: e.isNotNull())
    wrong = F.filter(tokens, lambda t: _unsupported(t, given))
    return F.coalesce(F.array_sort(F.array_distinct(wrong)), F.array(F.lit(NO_SECTION)))


def asserts_congestion(text: Column) -> Column:
    return F.lower(text).rlike("|".join(FORBIDDEN))


def admits_insufficiency(text: Column) -> Column:
    return F.contains(F.lower(text), F.lit(INSUFFICIENT))


def grounding_report(responses: DataFrame, needed: str = "anomaly_score") -> DataFrame:
    """All checks of each response; an answer must admit it when `needed` was not supplied."""
    text = F.col("response")
    wrong = unsupported_numbers(text, F.col("evidence"))
    admits = admits_insufficiency(text)
    return responses.withColumns({
        "sections_ok": has_sections(text),
        "unsupported": wrong,
        "numbers_ok": F.size(wrong) == 0,
        "no_congestion_claim": ~asserts_congestion(text),
        "insufficiency_detected": admits,
        "insufficiency_ok": admits | F.col(needed).isNotNull(),
    })
