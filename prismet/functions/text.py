"""Text expressions: identifiers, labels, reports, prompts and verdicts."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
VERDICTS = ("Unaligned", "Uncertain", "Aligned")  # the longest first
ALIASES = {
    "support": "Aligned", "supports": "Aligned", "supported": "Aligned",
    "contradict": "Unaligned", "contradicts": "Unaligned", "contradicted": "Unaligned",
    "deny": "Unaligned", "denies": "Unaligned", "denied": "Unaligned",
    "ambiguous": "Uncertain", "ambiguity": "Uncertain", "unclear": "Uncertain",
}
NO_CONCEPTS = "No active concepts detected."
RETRY_SUFFIX = "\n\nIMPORTANT: Your previous answer was not in the expected format. You MUST follow the format: <max 25 words explanation> | Verdict: <Aligned/Unaligned/Uncertain>"
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def is_image_name(name: Column) -> Column:
    low = F.lower(name)
    return F.endswith(low, F.lit(".jpg")) | F.endswith(low, F.lit(".jpeg")) | F.endswith(low, F.lit(".png"))


def rid_from_uri(uri: Column) -> Column:
    """After the last slash, else after the last colon, else the text itself."""
    t = F.trim(uri)
    return F.when(F.contains(t, F.lit("/")), F.element_at(F.split(t, "/"), -1)).when(F.contains(t, F.lit(":")), F.element_at(F.split(t, ":"), -1)).otherwise(t)


def clinical_labels(*fields: Column) -> Column:
    """Parts between semicolons, each up to its first slash, trimmed and lower-cased; neither empty nor `normal`; distinct."""
    parts = F.flatten(F.array(*[F.split(F.coalesce(f, F.lit("")), ";") for f in fields]))
    heads = F.transform(parts, lambda x: F.lower(F.trim(F.split(x, "/")[0])))
    return F.array_distinct(F.filter(heads, lambda x: (x != "") & (x != "normal")))


def mentions_any(labels: Column, keywords: Column) -> Column:
    """True where any keyword is part of any label."""
    return F.exists(keywords, lambda k: F.exists(labels, lambda x: F.contains(x, k)))


def report_text(findings: Column, impression: Column, fallback: str = "No report available.") -> Column:
    """Both sections with their headings; a fixed sentence where both are blank."""
    f, i = F.trim(F.coalesce(findings, F.lit(""))), F.trim(F.coalesce(impression, F.lit("")))
    both = F.concat_ws(" ", F.when(f != "", F.concat(F.lit("Findings: "), f)), F.when(i != "", F.concat(F.lit("Impression: "), i)))
    return F.when(both == "", F.lit(fallback)).otherwise(both)


def lookup_text(findings: Column, impression: Column) -> Column:
    """Both sections without headings; null where both are blank."""
    f, i = F.trim(F.coalesce(findings, F.lit(""))), F.trim(F.coalesce(impression, F.lit("")))
    return F.nullif(F.concat_ws(" ", F.nullif(f, F.lit("")), F.nullif(i, F.lit(""))), F.lit(""))


def study_key(name: Column) -> Column:
    """`{patient}_IM-{study}` of an image name; names without the mark stay."""
    at = F.instr(name, "_IM-")
    rest = F.substring(name, at + 4, F.length(name))
    return F.when(at > 0, F.concat(F.substring(name, F.lit(1), at + 3), F.split(rest, "-")[0])).otherwise(name)


def uid_of(filename_uid: Column, name: Column) -> Column:
    """The uid found by file name, else the digits before the first underscore, else null."""
    return F.coalesce(filename_uid, F.nullif(F.regexp_extract(name, r"^(\d+)_", 1), F.lit("")).cast("long"))


def vocabulary_term(value: Column) -> Column:
    """A vocabulary entry is a JSON object with a term, or a bare string."""
    return F.coalesce(F.get_json_object(value, "$.term"), value)


def concept_list(names: Column) -> Column:
    return F.array_join(F.slice(names, 1, 5), ", ")


def fixed3(x: Column) -> Column:
    """A value with three decimals, rounded on the exact binary value, ties to even; nan and inf by these names.

    (Formatting functions of the JVM round the shortest decimal form instead: 0.2455 is a little less than it looks.)
    The value times a power of two is a whole number: its 53 bits fit a long in every tier of sizes, the smallest tier
    (below 2**-7, far below half a thousandth's last place) rounds beyond 2**-66."""
    size = F.abs(x)
    tiers = [(2.0**-7, 66), (2.0**3, 60), *((2.0 ** (13 + 10 * i), 49 - 10 * i) for i in range(4))]  # up to 2**43 and scale 2**19
    by_tier = lambda of: functools.reduce(lambda rest, t: F.when(size < t[0], of(t[1])).otherwise(rest), reversed(tiers), F.lit(None))
    units = by_tier(lambda power: (size * float(1 << power)).cast("long").cast("decimal(20,0)"))
    half, whole = (by_tier(lambda power, up=up: F.lit(str(1 << (power + up))).cast("decimal(21,0)")) for up in (0, 1))
    doubled = (units * F.lit(2000).cast("decimal(4,0)") + half).cast("decimal(30,0)")
    n = F.call_function("div", doubled, whole)
    n = F.when((doubled % whole == 0) & (n % 2 == 1), n - 1).otherwise(n)
    small = F.concat(F.call_function("div", n, F.lit(1000)).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))
    # From 2**43 on a double has at most nine binary places, which a decimal holds exactly.
    large = F.bround(size.cast("decimal(38,9)"), 3).cast("decimal(38,3)").cast("string")
    text = F.when(size < 2.0**43, small).when(size < 1e28, large).otherwise(size.cast("string"))
    return F.when(F.isnan(x), "nan").when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(F.concat(F.when(x < 0, "-").otherwise(""), text))


def pseudo_report(concepts: Column) -> Column:
    """Report sentence for array<struct<feature_id,name,activation>>, highest first."""
    names = F.transform(concepts, lambda c: c["name"])
    top = F.element_at(concepts, 1)
    text = F.concat(
        F.lit("The model identifies the following visual concepts in this radiograph: "), concept_list(names), F.lit(". The dominant concept is '"), top["name"],
        F.lit("' (activation="), fixed3(top["activation"]), F.lit(").")
    )
    return F.when(F.size(concepts) == 0, F.lit(NO_CONCEPTS)).otherwise(text)


def findings_report(names: Column) -> Column:
    return F.concat(F.lit("Findings suggest: "), concept_list(names))


def named(name: Column, feature_id: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("unknown_feature_"), feature_id.cast("string")))


def verdict(raw: Column) -> Column:
    """The verdict in a judge's answer, or null.

    After the last `Verdict:` any label, longest first, then any alias may occur as a part; otherwise, and where
    none does, a whole word of the answer must equal a label or an alias."""
    cased = F.split(F.coalesce(raw, F.lit("")), "Verdict:")
    said = F.lower(F.element_at(cased, -1))
    first = F.lit(None).cast("string")
    for alias, label in reversed(ALIASES.items()):
        first = F.when(F.contains(said, F.lit(alias)), label).otherwise(first)
    for label in reversed(VERDICTS):
        first = F.when(F.contains(said, F.lit(label.lower())), label).otherwise(first)
    words = F.split(F.lower(F.trim(raw)), r"\s+")
    second = F.lit(None).cast("string")
    for label in ("Uncertain", "Unaligned", "Aligned"):
        second = F.when(F.array_contains(words, label.lower()), label).otherwise(second)
    alias_map = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    by_alias = F.element_at(F.filter(F.transform(words, lambda w: alias_map[w]), lambda x: x.isNotNull()), 1)
    second = F.coalesce(second, F.when(F.size(F.filter(F.transform(words, lambda w: alias_map[w]), lambda x: x.isNotNull())) > 0, by_alias))
    return F.when(F.size(cased) > 1, F.coalesce(first, second)).otherwise(second)


def prompt(template: str, report: Column, pseudo: Column, retries: int = 0) -> Column:
    text = F.replace(F.replace(F.lit(template), F.lit("{report}"), report), F.lit("{pseudo_report}"), pseudo)
    return F.concat(text, F.lit(RETRY_SUFFIX)) if retries > 0 else text


def source_suffix(source: Column) -> Column:
    return F.when(source == "baseline", "").otherwise(F.concat(F.lit("_"), source))


def safe_model_name(model: Column) -> Column:
    return F.regexp_replace(model, "[/:]", "_")


def model_label(filename: Column) -> Column:
    """The model part of a score file's name."""
    return F.regexp_replace(F.regexp_replace(basename(filename), r"\.json$", ""), r"^judge_scores_", "")


def sha_prefix(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)
