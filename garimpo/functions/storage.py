"""Facts about storage devices read from titles, each with a confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions.edges import filled, found, has, plain_spaces, round2

# Brands by name, in the order in which they are tried.
BRANDS = (
    ("samsung", "SAMSUNG"), ("kingston", "KINGSTON"), ("crucial", "CRUCIAL"), ("wd", "WD"), ("western digital", "WD"), ("corsair", "CORSAIR"),
    ("lexar", "LEXAR"), ("xpg", "XPG"), ("intel", "INTEL"), ("amd", "AMD"), ("nvidia", "NVIDIA"), ("seagate", "SEAGATE"), ("transcend", "TRANSCEND"),
    ("sandisk", "SANDISK"), ("kingspec", "KINGSPEC"),
)
# Families that a bare number may be; other numbers have no family.
NUMBER_FAMILIES = ("870", "980", "990", "840")
# Where model and family stand in a title, in the order in which they are tried: (pattern, model group, family group).
MODELS = (
    (r"(?i)(\d{3,4})\s+(EVO|PRO|PLUS|TFT|ITL|QVO)", 1, 2),
    (r"(?i)(\d{3,4})\s+(Green|Blue|Black)\b", 1, 2),
    (r"(?i)([A-Z]{2}\d{2,4})\b", 1, 1),
    (r"(?i)([A-Z]\d{2,4})\b", 1, 1),
    (r"(?i)\b(NV\d+)\b", 1, 1),
    (r"(\d{3,4})\b", 1, 1),
)

FACTS = ("brand", "model", "family", "manufacturerSku", "capacityGB", "capacityTB", "canonicalCapacity", "interface", "protocol", "pcieGeneration", "formFactor")
CONFIDENCES = ("brand", "model", "capacityGB", "interface", "protocol", "pcieGeneration", "formFactor", "manufacturerSku")


def _first(*cases: tuple[Column, object], otherwise: object = None) -> Column:
    out = F.lit(otherwise)
    for when, value in reversed(cases):
        out = F.when(when, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def canonical(df: DataFrame, title: str = "title", *, brands: tuple = BRANDS, models: tuple = MODELS, number_families: tuple = NUMBER_FAMILIES) -> DataFrame:
    """df with the columns of FACTS and a struct `confidence` (CONFIDENCES and `overall`).

    A null or empty title has no facts and null confidences. `brands`, `models` and `number_families` take the place of the tables above. df's own columns of the same names are replaced. Facts that
    others depend on are computed in a step of their own, so each pattern is evaluated once.
    """
    t = plain_spaces(F.col(title))
    some = filled(F.col(title)).isNotNull()
    brand = _first(*[(has(t, rf"(?i)\b{name}\b"), value) for name, value in brands])
    hits = F.coalesce(*[F.when(has(t, p), F.struct(found(t, p, m).alias("model"), F.upper(found(t, p, f)).alias("family"), F.lit(k).alias("k"))) for k, (p, m, f) in enumerate(models)])
    tb, gb, g = found(t, r"(?i)\b(\d+\.?\d*)\s*TB\b"), found(t, r"(?i)\b(\d+\.?\d*)\s*GB\b"), found(t, r"(?i)\b(\d{3,4})G\b")
    near = lambda x: F.floor(x.try_cast("double") + F.lit(0.5)).cast("int")
    interface = _first(
        (has(t, r"(?i)\b(2280)\b|\bM\.2\b"), "M.2"), (has(t, r"(?i)\bM2\b"), "M.2"), (has(t, r"\bNV[Mm]e?\b"), "NVMe"),
        (has(t, r"\bPCI[-\s]?[Ee](?:2|3|4|5)?\b"), "PCIe"), (has(t, r"(?i)\bSATA"), "SATA"),
    )
    generation = _first(*[(has(t, rf"(?i)\bGen[ _]?{n}\b|\bPCIe[ _]?{n}\b"), n) for n in (5, 4, 3)])
    form = _first((has(t, r"(?i)\bM\.[2-4][0-6]\b|\bM\.2\b"), "M.2"), (has(t, r"\b2\.5[\"']?\b"), '2.5"'))
    df = df.withColumns({
        "__some": some, "__model": hits, "__tb": tb, "__gb": gb, "__g": g, "__nvme": has(t, r"(?i)\bNV[Mm]e?\b"),
        "brand": brand, "interface": interface, "pcieGeneration": generation.cast("int"), "formFactor": form,
        "__sku1": found(t, r"\b([A-Z]{2,4}\d{2,4}[A-Z]\d{2}/\d+[A-Z])\b"), "__sku2": F.upper(found(t, r"(?i)\b(WD[SBE]\d{3,4}T\dG\d[A-Z]+)\b")),
        "__sku3": found(t, r"\b([A-Z]{2}\d{3,5}[A-Z]{2,4})\b"), "__short": has(t, r"(?i)\b(A\d{3}|M[XP]\d{3})\b"),
    })
    known = F.col("interface")
    family = F.when((F.col("__model.k") < len(models) - 1) | F.col("__model.family").isin(*number_families), F.col("__model.family"))
    df = df.withColumns({
        "model": F.col("__model.model"), "family": family,
        "capacityGB": F.coalesce(F.floor(F.col("__tb").try_cast("double") * 1000 + F.lit(0.5)).cast("int"), near(F.col("__gb")), near(F.col("__g"))),
        "capacityTB": F.col("__tb").try_cast("double"),
        "protocol": F.when(known == "NVMe", "NVMe").when(known == "SATA", "SATA").when(known.isNotNull(), F.when(F.col("__nvme"), "NVMe").otherwise("SATA")),
    })
    df = df.withColumns({
        "canonicalCapacity": F.when(F.col("__some"), F.coalesce(F.concat(F.col("capacityGB").cast("string"), F.lit("GB")), F.lit(""))),
        "manufacturerSku": F.coalesce("__sku1", "__sku2", "__sku3", F.when(F.col("__short"), F.col("family"))),
    })
    sure = {
        "brand": F.when(F.col("brand").isNotNull(), 0.9).otherwise(0.6),
        "model": F.when(F.col("model").isNotNull(), 0.85).otherwise(0.5),
        "capacityGB": F.when(F.col("__tb").isNotNull() | F.col("__gb").isNotNull(), 0.95).when(F.col("__g").isNotNull(), 0.85).otherwise(0.5),
        "interface": F.when(known == "M.2", 0.8).when(known.isNotNull(), 0.95).otherwise(0.7),
        "protocol": F.when(known.isin("NVMe", "SATA"), 0.95).when(known.isNotNull(), 0.75).otherwise(0.7),
        "pcieGeneration": F.when(F.col("pcieGeneration").isNotNull(), 0.9).otherwise(0.7),
        "formFactor": F.when(F.col("formFactor").isNotNull(), 0.9).otherwise(0.5),
        "manufacturerSku": F.when(F.col("__sku1").isNotNull(), 0.95).when(F.col("__sku2").isNotNull(), 0.9).when(F.col("__sku3").isNotNull(), 0.85).when(F.col("manufacturerSku").isNotNull(), 0.7).otherwise(0.5),
    }
    total = sum((sure[c] for c in CONFIDENCES[1:]), sure["brand"])
    confidence = F.struct(*[sure[c].alias(c) for c in CONFIDENCES], round2(total / F.lit(8.0)).alias("overall"))
    df = df.withColumn("confidence", F.when(F.col("__some"), confidence))
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def flat(df: DataFrame) -> DataFrame:
    """One flat record per row of `canonical`: unknown brand and model by name, capacity in GB with the unit it was read in."""
    return df.withColumns({
        "brand": F.coalesce("brand", F.lit("Unknown")),
        "model": F.coalesce("model", F.lit("Unknown")),
        "capacity": F.coalesce(F.when(F.col("capacityGB") != 0, F.col("capacityGB").cast("double")), F.col("capacityTB")),
        "capacityUnit": F.when(F.col("capacityTB") != 0, "TB").otherwise("GB"),
        "overall": F.col("confidence.overall"),
    })
