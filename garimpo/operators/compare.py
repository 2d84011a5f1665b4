"""Explainable comparison of two canonical storage devices: a rule per field, a confidence and a verdict.

Rules give each field a status: MATCH, MISMATCH or UNKNOWN. The confidence is the share of fields that don't mismatch, less
a tenth of the share of unknown ones, and capped where a critical field mismatches. Everything is column expressions over
two structs, so a comparison is part of whatever plan produces the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions.edges import edged, filled, let, round2

# Other names of brands, interfaces and part-number beginnings; pairs that are compatible; ranks of submodels.
BRAND_ALIASES = {"WESTERN DIGITAL": "WD", "WDC": "WD", "WD BLUE": "WD", "WD BLACK": "WD", "SAMSUNG ELECTRONICS": "SAMSUNG", "KINGSTON TECHNOLOGY": "KINGSTON", "CORSAIR COMPONENTS": "CORSAIR"}
INTERFACE_ALIASES = {"NVM EXPRESS": "NVME", "M2": "M.2", "M.2 2280": "M.2", "PCI EXPRESS": "PCIE", "SATA III": "SATA", "SATA 3": "SATA"}
SKU_ALIASES = {"WDBLUESN580": "WESTERNDIGITALBLUESN580", "WDBLACKSN850X": "WESTERNDIGITALBLACKSN850X", "WDBLUE": "WESTERNDIGITALBLUE", "WDBLACK": "WESTERNDIGITALBLACK", "WDC": "WESTERNDIGITAL"}
COMPATIBLE_INTERFACES = ("NVME,M.2", "M.2,NVME", "PCIE,M.2", "M.2,PCIE", "PCIE,NVME", "NVME,PCIE")
COMPATIBLE_FORM_FACTORS = ("M.2,2280", "2280,M.2", '2.5",SATA', 'SATA,2.5"')
CORSAIR_RANKS = {"SFU": 1, "MP510": 2, "MP600": 3, "P5": 5}
CAPACITY_TOLERANCE = 0.05

#: Fields that are always judged, and the one that is judged where a side has it.
FIELDS = ("manufacturerSku", "corsair", "brand", "model", "family", "capacity", "interface", "protocol", "pcieGeneration", "formFactor")
WARRANTY = "warranty"
#: Months that two warranties may differ by.
WARRANTY_TOLERANCE = 1
#: What `compare` needs of each side; `warranty` (months) is optional.
INPUTS = ("brand", "model", "family", "manufacturerSku", "capacityGB", "interface", "protocol", "pcieGeneration", "formFactor")


def _alias(x: Column, table: dict[str, str]) -> Column:
    out = x
    for name, to in table.items():
        out = F.when(x == name, F.lit(to)).otherwise(out)
    return out


def normal_brand(x: Column) -> Column:
    return _alias(F.trim(F.regexp_replace(F.upper(filled(x)), "[^A-Z0-9]+", " ")), BRAND_ALIASES)


def normal_sku(x: Column) -> Column:
    return _alias(F.regexp_replace(F.upper(filled(x)), "[^A-Z0-9]", ""), SKU_ALIASES)


def normal_model(x: Column) -> Column:
    generic = F.regexp_replace(F.upper(filled(x)), edged(r"\b(?:SSD|HDD|NVME|PCIE|PCI EXPRESS|SATA|M\.2|M2|2280|GEN\s*\d+)\b"), " ")
    return F.trim(F.regexp_replace(generic, "[^A-Z0-9]+", " "))


def normal_interface(x: Column) -> Column:
    return _alias(F.trim(F.regexp_replace(F.upper(filled(x)), "[^A-Z0-9.]+", " ")), INTERFACE_ALIASES)


def _status(a: Column, b: Column, same: Column, *, soft: bool = False) -> Column:
    """Status of a field: unknown if both sides are absent; one absent side mismatches, unless the rule is soft."""
    return (
        F.when(a.isNull() & b.isNull(), "UNKNOWN")
        .when(a.isNull() | b.isNull(), "UNKNOWN" if soft else "MISMATCH")
        .when(F.coalesce(same, F.lit(False)), "MATCH")
        .otherwise("MISMATCH")
    )


def capacity_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(F.abs(a - b).cast("double"), F.greatest(a, b).cast("double"))


def statuses(left: str = "l", right: str = "r", *, warranty: bool = False) -> Column:
    """struct of the status of each of FIELDS and WARRANTY.

    `corsair` is null unless both are Corsair devices with a part number, and `warranty` unless a side has one; without
    the argument `warranty` the sides need no such field.
    """
    of = lambda c: (filled(F.col(f"{left}.{c}")), filled(F.col(f"{right}.{c}")))
    raw = lambda c: (F.col(f"{left}.{c}"), F.col(f"{right}.{c}"))
    sku, brand, model, family, interface, protocol, form = (of(c) for c in ("manufacturerSku", "brand", "model", "family", "interface", "protocol", "formFactor"))
    capacity, generation = raw("capacityGB"), raw("pcieGeneration")
    skus = [normal_sku(x) for x in sku]
    short = (F.length(skus[0]) < 6) | (F.length(skus[1]) < 6)
    both = sku[0].isNotNull() & sku[1].isNotNull()
    by_sku = F.when(both & (skus[0] != skus[1]) & short, "UNKNOWN").otherwise(_status(*sku, skus[0] == skus[1]))
    rank = lambda x: _alias(x, {k: str(v) for k, v in CORSAIR_RANKS.items()}).try_cast("int")
    ranked = [F.when(x.isin(*CORSAIR_RANKS), rank(x)) for x in skus]
    near = (skus[0] == skus[1]) | F.coalesce(F.abs(ranked[0] - ranked[1]) <= 1, F.lit(False))
    corsair = F.when(both & (normal_brand(brand[0]) == "CORSAIR") & (normal_brand(brand[1]) == "CORSAIR"), F.when(near, "MATCH").otherwise("MISMATCH"))
    models = [normal_model(x) for x in model]
    words = [F.filter(F.split(x, " "), lambda w: w != "") for x in models]
    within = lambda a, b: F.forall(a, lambda w: F.array_contains(b, w))
    contained = F.when(F.size(words[0]) <= F.size(words[1]), within(words[0], words[1])).otherwise(within(words[1], words[0]))
    same_model = (models[0] == models[1]) | ((F.size(words[0]) > 0) & (F.size(words[1]) > 0) & contained)
    ways = [normal_interface(x) for x in interface]
    months = raw(WARRANTY) if warranty else (F.lit(None).cast("int"),) * 2
    by_warranty = F.when(months[0].isNotNull() | months[1].isNotNull(), _status(*months, F.abs(months[0] - months[1]) <= WARRANTY_TOLERANCE))
    upper = lambda p: [F.trim(F.upper(x)) for x in p]
    families, forms = upper(family), upper(form)
    return F.struct(
        by_sku.alias("manufacturerSku"),
        corsair.alias("corsair"),
        _status(*brand, normal_brand(brand[0]) == normal_brand(brand[1])).alias("brand"),
        _status(*model, same_model).alias("model"),
        _status(*family, families[0] == families[1]).alias("family"),
        _status(*capacity, capacity_ratio(*capacity) <= CAPACITY_TOLERANCE).alias("capacity"),
        _status(*interface, (ways[0] == ways[1]) | F.concat_ws(",", *ways).isin(*COMPATIBLE_INTERFACES), soft=True).alias("interface"),
        _status(*protocol, normal_interface(protocol[0]) == normal_interface(protocol[1]), soft=True).alias("protocol"),
        _status(*generation, F.abs(generation[0] - generation[1]) <= 1, soft=True).alias("pcieGeneration"),
        _status(*form, (forms[0] == forms[1]) | F.concat_ws(",", *forms).isin(*COMPATIBLE_FORM_FACTORS), soft=True).alias("formFactor"),
        by_warranty.alias(WARRANTY),
    )


def compare(pairs: DataFrame, left: str = "l", right: str = "r") -> DataFrame:
    """pairs with `status` (struct of FIELDS and WARRANTY), `confidence` and `verdict`.

    `left` and `right` are struct columns with INPUTS. Where both have `warranty` (months) as well, it is one more field
    of the pairs that state one on either side. Where a side is null the verdict is UNKNOWN with 0.5.
    """
    has = lambda side: WARRANTY in pairs.select(f"{side}.*").columns
    warranty = has(left) and has(right)
    missing = F.col(left).isNull() | F.col(right).isNull()
    long_skus = (F.length(normal_sku(F.col(f"{left}.manufacturerSku"))) >= 6) & (F.length(normal_sku(F.col(f"{right}.manufacturerSku"))) >= 6)

    def score(s: Column) -> Column:
        count = lambda value: sum((F.coalesce(s[f] == value, F.lit(False)).cast("int") for f in (*FIELDS[1:], WARRANTY)), (s[FIELDS[0]] == value).cast("int"))
        total = F.lit(9) + s["corsair"].isNotNull().cast("int") + s[WARRANTY].isNotNull().cast("int")
        share = (total - count("MISMATCH")).cast("double") / total.cast("double")
        return round2(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share - count("UNKNOWN").cast("double") / total.cast("double") * F.lit(0.1))))

    def capped(s: Column, raw: Column) -> Column:
        is_ = lambda f, value: F.coalesce(s[f] == value, F.lit(False))
        critical_sku = F.coalesce(long_skus, F.lit(False)) & (is_("manufacturerSku", "MISMATCH") | is_("corsair", "MISMATCH"))
        sku_match = is_("manufacturerSku", "MATCH") | is_("corsair", "MATCH")
        weak = is_("capacity", "MISMATCH") | (~sku_match & is_("model", "MISMATCH") & is_("family", "MISMATCH"))
        return F.when(is_("brand", "MISMATCH") | critical_sku, F.least(raw, F.lit(0.39))).when(weak, F.least(raw, F.lit(0.69))).otherwise(raw)

    def judge(s: Column) -> Column:
        verdict = lambda c: F.when(c >= 0.9, "IDENTICAL").when(c >= 0.7, "LIKELY_IDENTICAL").when(c >= 0.4, "DIFFERENT").otherwise("UNKNOWN")
        confidence = let(score(s), lambda raw: capped(s, raw))
        return let(confidence, lambda c: F.struct(s.alias("status"), c.alias("confidence"), verdict(c).alias("verdict")))

    df = pairs.withColumn("__judged", F.when(~missing, let(statuses(left, right, warranty=warranty), judge)))
    judged = F.col("__judged")
    return df.withColumns({"status": judged["status"], "confidence": F.coalesce(judged["confidence"], F.lit(0.5)), "verdict": F.coalesce(judged["verdict"], F.lit("UNKNOWN"))}).drop("__judged")


def number_text(x: Column) -> Column:
    """A number as text without a trailing ".0"."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def reasons(left: str = "l", right: str = "r") -> Column:
    """array<struct<field, leftValue, rightValue, canonicalValue, reason, status>> for pairs that `compare` has judged."""
    s = lambda f: F.col(f"status.{f}")
    text = lambda c, pre="", post="": tuple(F.concat(F.lit(pre), filled(F.col(f"{side}.{c}").cast("string")), F.lit(post)) for side in (left, right))
    known = lambda a, b: a.isNotNull() & b.isNotNull()

    def reason(field: str, values: tuple[Column, Column], both: str, one: str, match: Column | str, mismatch: Column | str, *, named: bool = False, status: Column | None = None) -> Column:
        """`named`: an absent side is shown as Unknown rather than null."""
        st = s(field) if status is None else status
        a, b = values
        unknown_both = a.isNull() & b.isNull()
        show = lambda x: F.when(unknown_both, F.lit("Unknown")).otherwise(F.coalesce(x, F.lit("Unknown")) if named else x)
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        why = F.when(unknown_both, F.lit(both)).when(~known(a, b), F.lit(one)).when(st == "MATCH", lit(match)).otherwise(lit(mismatch))
        canonical = F.when(st == "MATCH", F.coalesce(a, b)).when(st == "UNKNOWN", F.lit("Unknown"))
        return F.struct(F.lit(field).alias("field"), show(a).alias("leftValue"), show(b).alias("rightValue"), canonical.alias("canonicalValue"), why.alias("reason"), st.alias("status"))

    skus, brands, families = text("manufacturerSku"), text("brand"), text("family")
    sizes, forms, ways = text("capacityGB", post="GB"), text("formFactor"), text("interface")
    alias = (normal_brand(brands[0]) != F.trim(F.upper(brands[0]))) | (normal_brand(brands[1]) != F.trim(F.upper(brands[1])))
    ratio = capacity_ratio(F.col(f"{left}.capacityGB"), F.col(f"{right}.capacityGB"))
    w = [normal_interface(x) for x in ways]
    compatible = F.concat_ws(",", *w).isin(*COMPATIBLE_INTERFACES)
    generations = text("pcieGeneration", pre="Gen")
    ff = F.concat_ws(",", *[F.trim(F.upper(x)) for x in forms]).isin(*COMPATIBLE_FORM_FACTORS)
    n = [normal_sku(x) for x in skus]
    holds = lambda x: F.regexp_like(x, F.lit("SFU|MP510|MP600|P5"))
    corsair_why = (
        F.when(n[0] == n[1], "Corsair SKU exact match").when(s("corsair") == "MATCH", "Corsair submodel proximity")
        .when(holds(n[0]) & holds(n[1]), "Corsair submodel mismatch").otherwise("Corsair SKU comparison")
    )
    corsair = F.struct(F.lit("manufacturerSku").alias("field"), skus[0].alias("leftValue"), skus[1].alias("rightValue"), s("corsair").alias("canonicalValue"), corsair_why.alias("reason"), s("corsair").alias("status"))
    rows = F.array(
        reason("manufacturerSku", skus, "Both SKUs unknown", "One SKU unknown", "SKU match", F.when(s("manufacturerSku") == "UNKNOWN", "Short SKU token not decisive").otherwise("SKU mismatch")),
        F.when(s("corsair").isNotNull(), corsair),
        reason("brand", brands, "Both brands unknown", "One brand unknown", F.when(alias, "Brand alias match").otherwise("Brand match"), "Brand mismatch"),
        reason("model", text("model"), "Both models unknown", "One model unknown", "Model token match", "Model mismatch"),
        reason("family", families, "Both families unknown", "One family unknown", "Family match", F.concat(F.lit("Family mismatch ("), F.trim(F.upper(families[0])), F.lit(" != "), F.trim(F.upper(families[1])), F.lit(")"))),
        reason("capacity", sizes, "Both capacities unknown", "One capacity unknown", F.when(ratio == 0, "Capacity match").otherwise("Capacity match (within 5% tolerance)"),
               F.concat(F.lit("Capacity mismatch ("), sizes[0], F.lit(" vs "), sizes[1], F.lit(", diff="), F.coalesce(number_text(round2(ratio * 100)), F.lit("NaN")), F.lit("%)")), named=True),
        reason("interface", ways, "Both interfaces unknown", "One interface unknown", F.when(compatible, F.concat(F.lit("Interface compatible ("), w[0], F.lit("/ "), w[1], F.lit(")"))).otherwise("Interface match"), "Interface mismatch", named=True),
        reason("protocol", text("protocol"), "Both protocols unknown", "One protocol unknown", "Protocol match", "Protocol mismatch", named=True),
        reason("pcieGeneration", generations, "Both PCIe generations unknown", "One PCIe generation unknown", F.when(generations[0] == generations[1], "PCIe generation match").otherwise("Adjacent PCIe generation"), "Different PCIe generation", named=True),
        reason("formFactor", forms, "Both form factors unknown", "One form factor unknown", F.when(ff, "Form factor compatible").otherwise("Form factor match"), "Form factor mismatch", named=True),
    )
    return F.array_compact(rows)


def warranty_reason(left: str = "l", right: str = "r") -> Column:
    """The reason of the warranty rule, null for pairs without it. It belongs to the identical or differing fields, not to `reasons`."""
    a, b = (F.col(f"{side}.{WARRANTY}") for side in (left, right))
    st = F.col(f"status.{WARRANTY}")
    show = lambda x: F.coalesce(F.concat(x.cast("string"), F.lit(" months")), F.lit("Unknown"))
    # Texts of the rule.
    why = F.when(a.isNull() | b.isNull(), "One warranty unknown").when(a == b, "Warranty match").when(st == "MATCH", "Warranty within tolerance").otherwise("Warranty mismatch")
    row = F.struct(F.lit(WARRANTY).alias("field"), show(a).alias("leftValue"), show(b).alias("rightValue"), F.when(st == "MATCH", show(a)).alias("canonicalValue"), why.alias("reason"), st.alias("status"))
    return F.when(st.isNotNull(), row)


def evidence(rows: Column) -> Column:
    """Reasons as the older matchers report them: array<struct<rule, left, right, matched, detail, status, canonicalValue>>."""
    return F.transform(rows, lambda r: F.struct(
        r["field"].alias("rule"), r["leftValue"].alias("left"), r["rightValue"].alias("right"), (r["status"] != "MISMATCH").alias("matched"), r["reason"].alias("detail"), r["status"].alias("status"), r["canonicalValue"].alias("canonicalValue"),
    ))


def fields_with(status: str, rows: Column) -> Column:
    """The reasons with a status: identical (MATCH), differing (MISMATCH) or unknown (UNKNOWN) fields."""
    return F.filter(rows, lambda r: r["status"] == status)


def report(verdict: Column, confidence: Column, rows: Column) -> Column:
    """A comparison as a Markdown text."""
    shown = lambda x: F.coalesce(x, F.lit("null"))
    bold = lambda r: F.concat(F.lit("**"), r["field"], F.lit("**"))
    listed = lambda items, none: F.when(F.size(items) == 0, F.lit(none)).otherwise(F.array_join(items, "\n"))
    same = F.transform(fields_with("MATCH", rows), lambda r: F.concat(F.lit("- "), bold(r), F.lit(": "), shown(r["canonicalValue"]), F.lit(" ("), r["reason"], F.lit(")")))
    other = F.transform(fields_with("MISMATCH", rows), lambda r: F.concat(F.lit("- "), bold(r), F.lit(": "), shown(r["leftValue"]), F.lit(" vs "), shown(r["rightValue"]), F.lit(" ("), r["reason"], F.lit(")")))
    open_ = F.transform(fields_with("UNKNOWN", rows), lambda r: F.concat(F.lit("- "), bold(r), F.lit(": "), r["reason"]))
    all_ = F.transform(rows, lambda r, k: F.concat((k + 1).cast("string"), F.lit(". "), bold(r), F.lit(" — status="), r["status"], F.lit(", left="), shown(r["leftValue"]), F.lit(", right="), shown(r["rightValue"]), F.lit(", canonical="), shown(r["canonicalValue"])))
    return F.concat_ws(
        "\n", F.lit("# Product Comparison Report"), F.lit(""), F.concat(F.lit("## Verdict: "), verdict, F.lit(" (confidence: "), number_text(confidence), F.lit(")")), F.lit(""),
        F.lit("## Identical Specifications"), listed(same, "- None"), F.lit(""), F.lit("## Differing Specifications"), listed(other, "- None"), F.lit(""),
        F.lit("## Unknown Specifications"), listed(open_, "- None (all fields resolved)"), F.lit(""), F.lit("## All ComparisonReason Objects"), F.lit(""), F.array_join(all_, "\n"), F.lit(""),
    )


def legacy_matches(left: str = "l", right: str = "r") -> Column:
    """struct<sku, brand, model, family, capacity, interface, protocol, pcieGeneration, formFactor: boolean> of the older field matchers.

    Both sides absent: matched. One absent: not matched, except for family. A shared run of digits is enough for models.
    """
    def field(c: str, same: Column, one: bool = False) -> Column:
        a, b = F.col(f"{left}.{c}"), F.col(f"{right}.{c}")
        return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), one).otherwise(F.coalesce(same, F.lit(False)))

    up = lambda c: [F.trim(F.upper(F.col(f"{s}.{c}"))) for s in (left, right)]
    bare = lambda c: [F.regexp_replace(F.upper(F.col(f"{s}.{c}")), "[^A-Z0-9]", "") for s in (left, right)]
    digits = lambda s: F.regexp_extract_all(F.col(f"{s}.model"), F.lit(r"(\d+)"), F.lit(1))
    b, sku, fam, way, prot, form = up("brand"), bare("manufacturerSku"), up("family"), up("interface"), up("protocol"), up("formFactor")
    models = [F.trim(F.regexp_replace(F.upper(F.col(f"{s}.model")), r"\s+", " ")) for s in (left, right)]
    gen = [F.col(f"{s}.pcieGeneration") for s in (left, right)]
    cap = [F.col(f"{s}.capacityGB") for s in (left, right)]
    wd = ((b[0] == "WD") & b[1].isin("WESTERN DIGITAL", "WD BLUE")) | ((b[0] == "WESTERN DIGITAL") & (b[1] == "WD"))
    return F.struct(
        field("manufacturerSku", sku[0] == sku[1]).alias("sku"),
        field("brand", wd | (b[0] == b[1])).alias("brand"),
        field("model", F.arrays_overlap(digits(left), digits(right)) | (models[0] == models[1])).alias("model"),
        field("family", fam[0] == fam[1], one=True).alias("family"),
        field("capacityGB", capacity_ratio(*cap) <= CAPACITY_TOLERANCE).alias("capacity"),
        field("interface", F.concat_ws(",", *way).isin(*COMPATIBLE_INTERFACES) | (way[0] == way[1])).alias("interface"),
        field("protocol", prot[0] == prot[1]).alias("protocol"),
        field("pcieGeneration", F.abs(gen[0] - gen[1]) <= 1).alias("pcieGeneration"),
        field("formFactor", F.concat_ws(",", *form).isin(*COMPATIBLE_FORM_FACTORS) | (form[0] == form[1])).alias("formFactor"),
    )
