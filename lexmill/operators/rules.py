"""Zone rules, checklists and project analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import scalars as S

#: Zone, front, side and rear setbacks in feet, their code, coverage in per cent, its code, and the feet of the height limits: standard or flat roof, and pitched roof where it differs.
ZONES = [
    ("SF 5000", 20, 5, 25, "SMC 23.44.014", 35, "SMC 23.44.012", 30, 35),
    ("SF 7200", 20, 5, 25, "SMC 23.44.014", 35, "SMC 23.44.012", 30, 35),
    ("LR1", 10, 5, 15, "SMC 23.45.514", 60, "SMC 23.45.512", 30, None),
]
#: Tiers of trees by diameter, what protects them, and the code; replacement ratios; inventory; permits.
TREE_TIERS = [
    ("tier1", 'Exceptional trees (≥24" diameter, or 30" for certain species)', "Must be protected unless hazardous or emergency", "SMC 25.11.020, SMC 25.11.070"),
    ("tier2", 'Significant trees (12"-24" diameter)', "May not be removed unless hazardous, emergency, or for allowed development", "SMC 25.11.070, SMC 25.11.080"),
    ("tier3", 'Trees 6"-12" diameter', "May be removed or protected at owner option", "SMC 25.11.080"),
]
REPLACEMENT = [("under 12 inches", 1, "SMC 25.11.090"), ("12 to 24 inches", 2, "SMC 25.11.090"), ("over 24 inches", 3, "SMC 25.11.090")]
INVENTORY = (6, "4.5 feet above ground (diameter at breast height)", "SMC 25.11.050")
PERMITS = [
    ("building", "Building permit application through Seattle Services Portal", "SMC 22.801"),
    ("tree removal", "Tree Removal and Replacement Plan", "SMC 25.11.060"),
]
DEFAULT_ZONE = "SF 5000"
ZONE_SCHEMA = "zone string, front_ft int, side_ft int, rear_ft int, setback_code string, max_lot_pct int, lot_code string, height_ft int, pitched_ft int"


def code_reference() -> dict:
    """All rules as one document, which a prompt can hold."""
    names = [c.split()[0] for c in ZONE_SCHEMA.split(", ")]
    return {
        "zoning": {z[0]: dict(zip(names[1:], z[1:], strict=True)) for z in ZONES},
        "trees": {
            "tiers": {t: {"description": d, "protection": p, "code": c} for t, d, p, c in TREE_TIERS},
            "replacement": {size: {"ratio": n, "code": c} for size, n, c in REPLACEMENT},
            "inventory": dict(zip(("inches", "measured", "code"), INVENTORY, strict=True)),
        },
        "permits": {name: {"description": d, "code": c} for name, d, c in PERMITS},
    }


def zone_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ZONES, ZONE_SCHEMA)


def with_rules(df: DataFrame, rules: DataFrame, zone: str = "zone_classification") -> DataFrame:
    """Every row with its zone's rules, or those of the default zone; the rules are three rows."""
    known = F.broadcast(rules.select(F.col("zone").alias("_z"), F.struct(*(F.col(c) for c in rules.columns)).alias("_rule")))
    default = F.broadcast(rules.filter(F.col("zone") == DEFAULT_ZONE).select(F.lit(True).alias("_on"), F.struct(*(F.col(c) for c in rules.columns)).alias("_default")))
    out = df.join(known, F.col(zone) == F.col("_z"), "left").withColumn("_yes", F.lit(True)).join(default, F.col("_yes") == F.col("_on"), "left")
    return out.withColumn("rule", F.coalesce("_rule", "_default")).drop("_z", "_rule", "_on", "_default", "_yes")


def max_coverage(sqft: Column, percent: Column) -> Column:
    return F.floor(sqft * (percent / 100)).cast("long")


def checklist(df: DataFrame) -> DataFrame:
    """``checklist``: categories of items for a property with its ``rule``."""
    # Categories, tasks, descriptions and codes are fixed values.
    r = F.col("rule")

    def item(task: str, description: Column, code: Column, requirement: Column) -> Column:
        return F.struct(F.lit(task).alias("task"), F.lit(True).alias("required"), description.alias("description"), code.alias("code"), requirement.alias("requirement"))

    def category(name: str, *items: Column) -> Column:
        return F.struct(F.lit(name).alias("category"), F.array(*items).alias("items"))

    most = max_coverage(F.col("lot_size_sqft"), r["max_lot_pct"])
    return df.withColumn(
        "checklist",
        F.array(
            category("Pre-Application Requirements", item("Verify property ownership", F.lit("Proof of ownership required"), F.lit("General"), F.format_string("For Parcel #%s at %s", "parcel_number", "address"))),
            category(
                "Zoning Requirements",
                item("Verify setback compliance", F.concat(F.lit("Setbacks for "), "zone_classification"), r["setback_code"], F.format_string("Front: %dft | Side: %dft | Rear: %dft", r["front_ft"], r["side_ft"], r["rear_ft"])),
                item("Calculate lot coverage", F.lit("Maximum lot coverage"), r["lot_code"], F.format_string("Max %d%% of %s sq ft = %s sq ft", r["max_lot_pct"], F.format_number("lot_size_sqft", 0), F.format_number(most, 0))),
            ),
            category("Tree Protection (SMC 25.11)", item("Complete tree inventory", F.lit('Document all trees ≥6" diameter'), F.lit(INVENTORY[2]), F.format_string("Property shows %d%% canopy. Inventory required.", "canopy_coverage"))),
            category("Required Permits", item("Building Permit", F.lit(PERMITS[0][1]), F.lit(PERMITS[0][2]), F.lit("Submit at cosaccela.seattle.gov/portal/"))),
        ),
    )


def analyse_project(df: DataFrame, text: str) -> DataFrame:
    """``project_types, square_feet, features`` of a free-form description."""
    return df.withColumn("project_types", S.project_types(F.col(text))).withColumn("square_feet", S.square_feet(F.col(text))).withColumn("features", S.project_features(F.col(text)))
