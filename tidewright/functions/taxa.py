"""Taxonomy to functional group rules, as data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Alternative = Mapping[str, Sequence[str]]

# Ordered group rules. A rule holds alternatives; an alternative holds required values per rank,
# and a rank name with a leading "!" lists values that must not occur. The first matching rule decides.
RULES_2025: list[tuple[str, list[Alternative]]] = [
    ("ZF1-ICT", [{"phylum": ["Chordata"], "!class": ["Appendicularia"]}]),
    ("ZS1-JEL", [{"phylum": ["Cnidaria"], "class": ["Scyphozoa"]}, {"phylum": ["Cnidaria"], "family": ["Aequoreidae"]}]),
    ("ZS2-CTH", [{"phylum": ["Ctenophora"]}, {"phylum": ["Cnidaria"], "class": ["Hydrozoa"], "!family": ["Aequoreidae"]}]),
    ("ZS3-CHA", [{"phylum": ["Chaetognatha"]}, {"class": ["Polychaeta", "Gastropoda"]}]),
    ("ZS4-LAR", [{"class": ["Appendicularia"]}]),
    ("ZC5-CSM", [{"order": ["Calanoida"], "!family": ["Calanidae", "Eucalanidae"]}, {"class": ["Ostracoda"]},
                 {"family": ["Oithonidae", "Maxillopoda"]}]),
    ("ZC4-CLG", [{"family": ["Calanidae", "Eucalanidae"]}, {"order": ["Poecilostomatoida"]}]),
    ("ZC3-DEC", [{"order": ["Decapoda", "Thecostraca"]}, {"family": ["Corycaeidae"]}]),
    ("ZC2-AMP", [{"order": ["Amphipoda"]}]),
    ("ZC1-EUP", [{"order": ["Euphausiacea"]}]),
]
# Fixed values of the earlier version: other code for fish larvae, fewer small and large copepods and decapods.
RULES_EARLIER: list[tuple[str, list[Alternative]]] = [
    ("ZF1-ICH", [{"phylum": ["Chordata"], "!class": ["Appendicularia"]}]),
    ("ZS1-JEL", [{"phylum": ["Cnidaria"], "class": ["Scyphozoa"]}, {"phylum": ["Cnidaria"], "family": ["Aequoreidae"]}]),
    ("ZS2-CTH", [{"phylum": ["Ctenophora"]}, {"phylum": ["Cnidaria"], "class": ["Hydrozoa"], "!family": ["Aequoreidae"]}]),
    ("ZS3-CHA", [{"phylum": ["Chaetognatha"]}, {"class": ["Polychaeta", "Gastropoda"]}]),
    ("ZS4-LAR", [{"class": ["Appendicularia"]}]),
    ("ZC5-CSM", [{"order": ["Calanoida"], "!family": ["Calanidae", "Eucalanidae"]}, {"class": ["Ostracoda"]}]),
    ("ZC4-CLG", [{"family": ["Calanidae", "Eucalanidae"]}]),
    ("ZC3-DEC", [{"order": ["Decapoda", "Thecostraca"]}]),
    ("ZC2-AMP", [{"order": ["Amphipoda"]}]),
    ("ZC1-EUP", [{"order": ["Euphausiacea"]}]),
]


def group_of(rules: Sequence[tuple[str, Sequence[Alternative]]], ranks: Mapping[str, Column], other: str = "misc") -> Column:
    """Group code from an ordered rule table; unknown taxa get ``other``."""
    def holds(alt: Alternative) -> Column:
        cond = F.lit(True)
        for rank, values in alt.items():
            if rank.startswith("!"):
                cond = cond & ~ranks[rank[1:]].isin(list(values))
            else:
                cond = cond & ranks[rank].isin(list(values))
        return F.coalesce(cond, F.lit(False))

    out: Column | None = None
    for code, alternatives in rules:
        hit = holds(alternatives[0])
        for alt in alternatives[1:]:
            hit = hit | holds(alt)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise(other)


# 1-D model column ids of the group codes.
SERIES_IDS = {
    "ZF1-ICT": 4, "ZC1-EUP": 5, "ZC2-AMP": 6, "ZC3-DEC": 7, "ZC4-CLG": 8, "ZC5-CSM": 9,
    "ZS1-JEL": 10, "ZS2-CTH": 11, "ZS3-CHA": 12, "ZS4-LAR": 13,
}

# Phytoplankton classes of the plankton groups.
CLASS_GROUPS = {
    "Diatoms": ["Bacillariophyceae"],
    "Nanophytoplankton": ["Choanoflagellatea", "Dictyochophyceae", "Cryptophyceae", "Metromonadea", "Chrysophyceae",
                          "Telonemea", "Chlorodendrophyceae", "Bicosoecophyceae", "Xanthophyceae", "Coccolithophyceae",
                          "Euglenophyceae", "Raphidophyceae"],
    "Picoplankton": ["Pyramimonadophyceae"],
    "Dinoflagellates": ["Dinophyceae"],
}


def rename_series(df: DataFrame, ids: Mapping[str, int] = SERIES_IDS, prefix: str = "") -> DataFrame:
    """Numeric column names of the 1-D model to group codes."""
    return df.withColumnsRenamed({str(i): f"{prefix}{g}" for g, i in ids.items() if str(i) in df.columns})
