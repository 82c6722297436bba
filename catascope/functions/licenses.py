"""License mapping: id, title or url to a registry id and its conformance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catascope.functions.text import filled

# Other ids of a license. None: known, but not in the registry.
ID_ALIASES = {
    "cc-by": "CC-BY-4.0",
    "cc0": "CC0-1.0",
    "cc-zero": "CC0-1.0",
    "cc-by-nd": None,
    "cc-by-nc-nd": None,
    "cc-by-nc-sa": None,
    "cc-nc": None,
    "cc-by-sa": None,
    "cc-nd": None,
    "CC-BY": "CC-BY-4.0",
    "cc-by-nc": None,
    "cc-by-igo": None,
    "cc-by-2.1": "CC-BY-4.0",
    "CC-BY-3.0": "CC-BY-4.0",
    "cc-by-4.0": "CC-BY-4.0",
    "uk-ogl": "OGL-UK-3.0",
    "ukcrown": "ukcrown",
    "ukcrown-withrights": "ukcrown-withrights",
    "dl-de-by-1.0": None,
    "iodl1": None,
    "iodl2": None,
    "other-nc": None,
    "other-open": None,
    "other-pd": None,
    "other-closed": None,
    "other-at": None,
    "dl-de-by-2.0": None,
    "odc-odbl": "ODbL-1.0",
    "publiek-domein": None,
    "odc-by": "ODC-BY-1.0",
    "odc-pddl": "ODC-PDDL-1.0",
    "gfdl": "GFDL-1.3-no-cover-texts-no-invariant-sections",
    "gpl-2.0": "GPL-2.0",
    "gpl-3.0": "GPL-3.0",
    "lgpl-2.1": "LGPL-2.1",
    "localauth-withrights": None,
    "official-work": None,
    "against-drm": "Against-DRM",
    "dl-de-by-nc-1.0": None,
}
# Other titles of a license.
TITLE_ALIASES = {
    "UK Open Government Licence (OGL)": "OGL-UK-3.0",
    "Creative Commons Attribution": "CC-BY-4.0",
    "Europa Legal Notice": None,
    "cc0": "CC0-1.0",
    "Creative Commons Attribuzione": "CC-BY-4.0",
    "Datenlizenz Deutschland Namensnennung": None,
    "License Not Specified": None,
    "Creative Commons CCZero": "CC0-1.0",
    "dl-de-by-1.0": None,
    "Creative Commons Attribution Share-Alike": None,
    "Open Data Commons Open Database License (ODbL)": None,
    "Open Data Commons Attribution License": "CC-BY-4.0",
    "GNU Free Documentation License": "GFDL-1.3-no-cover-texts-no-invariant-sections",
    "Other (Not Open)": "other-closed",
    "Other (Non-Commercial)": "other-nc",
    "Other (Attribution)": "other-at",
    "Open Data Commons Public Domain Dedication and License (PDDL)": "ODC-PDDL-1.0",
    "Open Data Commons Public Domain Dedication and Licence (PDDL)": "ODC-PDDL-1.0",
    "Creative Commons Non-Commercial (Any)": None,
    "Creative Commons Attribution 3.0 Australia": None,
    "Datenlizenz Deutschland Namensnennung 2.0": None,
    "iodl2": None,
    "Italian Open Data License 2.0": None,
    "Italian Open Data License v.2.0": None,
}

# Own small registry from the public open definition list: id, title, url, conformance.
# sources.registries.read_licenses reads the full one.
REGISTRY = [
    ("AFL-3.0", "Academic Free License 3.0", "https://opensource.org/licenses/AFL-3.0", "not reviewed"),
    ("Against-DRM", "Against DRM", "https://opendefinition.org/licenses/against-drm", "approved"),
    ("Apache-2.0", "Apache Software License 2.0", "https://www.apache.org/licenses/LICENSE-2.0", "not reviewed"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0", "https://creativecommons.org/licenses/by/4.0/", "approved"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0", "https://creativecommons.org/licenses/by-nc/4.0/", "rejected"),
    ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", "https://creativecommons.org/licenses/by-nc-nd/4.0/", "rejected"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0", "https://creativecommons.org/licenses/by-nd/4.0/", "rejected"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution Share-Alike 4.0", "https://creativecommons.org/licenses/by-sa/4.0/", "approved"),
    ("CC0-1.0", "CC0 1.0", "https://creativecommons.org/publicdomain/zero/1.0/", "approved"),
    ("DSL", "Design Science License", "https://opendefinition.org/licenses/dsl", "approved"),
    ("FAL-1.3", "Free Art License 1.3", "http://artlibre.org/licence/lal/en/", "approved"),
    ("GFDL-1.3-no-cover-texts-no-invariant-sections", "GNU Free Documentation License 1.3 with no cover texts and no invariant sections", "https://opendefinition.org/licenses/gfdl", "approved"),
    ("GPL-2.0", "GNU General Public License 2.0", "https://opensource.org/licenses/GPL-2.0", "not reviewed"),
    ("GPL-3.0", "GNU General Public License 3.0", "https://opensource.org/licenses/GPL-3.0", "not reviewed"),
    ("LGPL-2.1", "GNU Lesser General Public License 2.1", "https://opensource.org/licenses/LGPL-2.1", "not reviewed"),
    ("MIT", "MIT License", "https://opensource.org/licenses/MIT", "not reviewed"),
    ("MirOS", "MirOS License", "https://opensource.org/licenses/MirOS", "approved"),
    ("OGL-Canada-2.0", "Open Government License 2.0 (Canada)", "https://open.canada.ca/en/open-government-licence-canada", "approved"),
    ("OGL-UK-2.0", "Open Government Licence 2.0 (United Kingdom)", "http://www.nationalarchives.gov.uk/doc/open-government-licence/version/2/", "approved"),
    ("OGL-UK-3.0", "Open Government Licence 3.0 (United Kingdom)", "https://www.nationalarchives.gov.uk/doc/open-government-licence/version/3/", "approved"),
    ("ODC-BY-1.0", "Open Data Commons Attribution License 1.0", "https://opendatacommons.org/licenses/by", "approved"),
    ("ODC-PDDL-1.0", "Open Data Commons Public Domain Dedication and Licence 1.0", "https://opendatacommons.org/licenses/pddl", "approved"),
    ("ODbL-1.0", "Open Data Commons Open Database License 1.0", "https://opendatacommons.org/licenses/odbl", "approved"),
    ("Talis", "Talis Community License", "https://opendefinition.org/licenses/tcl", "not reviewed"),
    ("notspecified", "License Not Specified", "", "not reviewed"),
    ("other-at", "Other (Attribution)", "", "not reviewed"),
    ("other-closed", "Other (Not Open)", "", "not reviewed"),
    ("other-nc", "Other (Non-Commercial)", "", "not reviewed"),
    ("other-open", "Other (Open)", "", "not reviewed"),
    ("other-pd", "Other (Public Domain)", "", "not reviewed"),
    ("ukcrown", "UK Crown Copyright", "", "not reviewed"),
    ("ukcrown-withrights", "UK Crown Copyright with data.gov.uk rights", "", "not reviewed"),
]

# License names counted as open by the label list.
OPEN_LICENSE_LABELS = [
    "CC0", "CC0-1.0", "ODC-PDDL", "Open Data Commons Public Domain Dedication and Licence", "PDDL",
    "CC BY", "CC BY-2.5", "CC BY-3.0", "CC BY-3.0 AT", "CC BY-3.0 DE", "CC BY-3.0 ES",
    "CC BY-3.0 FI", "CC BY-3.0 IT", "CC BY-4.0", "ODC-BY", "CC BY-SA", "CC BY-SA-1.0 FI",
    "CC BY-SA-3.0 AT", "CC BY-SA-3.0 CH", "CC BY-SA-3.0 ES", "CC-BY-SA-4.0", "ODC-ODbL", "ODbL",
    "Free Art License", "FAL", "GFDL", "GNU FDL", "GNU GPL-2.0", "GNU GPL-3.0", "OGL",
    "OGL-UK-2.0", "OGL-UK-3.0 ", "Open Government Licence - Canada 2.0",
    "Open Government Licence Canada 2.0", "OGL-Canada-2.0", "MirOS License",
    "Talis Community License", "Against DRM", "DL-DE-BY-2.0",
    "Data licence Germany – attribution – version 2.0",
    "Data licence Germany –    Zero – version 2.0", "Design Science License",
    "EFF Open Audio License", "SPL", "W3C license",
]

NOT_FOUND = "not found"


def _table(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for item in pairs.items() for x in item])


def _first(rows, key: int) -> dict:
    out: dict = {}
    for row in rows:
        if row[key]:
            out.setdefault(row[key], row[0])
    return out


def map_license(title: Column, lid: Column, url: Column, registry=None) -> Column:
    """Struct (id, conformance) of a license, as an expression over a registry of fixed size."""
    rows = registry or REGISTRY
    ids = _table({r[0]: r[0] for r in rows})
    titles, urls = _table(_first(rows, 1)), _table(_first(rows, 2))
    conformance = _table({r[0]: r[3] for r in rows})
    find = F.try_element_at
    by_id = find(ids, F.coalesce(find(_table({k: v for k, v in ID_ALIASES.items() if v}), lid), lid))
    alias = F.coalesce(find(_table({k: v for k, v in TITLE_ALIASES.items() if v}), title), title)
    by_title = F.coalesce(find(ids, alias), find(titles, alias))
    own = F.coalesce(_some(lid), _some(title), url)
    mapped = F.coalesce(
        F.when(filled(lid), by_id),
        F.when(filled(title), by_title),
        F.when(filled(url), find(urls, url)),
        own,
    )
    return F.struct(
        mapped.alias("id"),
        F.coalesce(find(conformance, mapped), F.lit(NOT_FOUND)).alias("conformance"),
    )


def _some(c: Column) -> Column:
    return F.when(filled(c), c)


def license_conformance(lid: Column, registry=None) -> Column:
    rows = registry or REGISTRY
    return F.coalesce(F.try_element_at(_table({r[0]: r[3] for r in rows}), lid), F.lit(NOT_FOUND))


def is_open_license(lid: Column, registry=None) -> Column:
    return license_conformance(lid, registry) == "approved"


def map_licenses(df: DataFrame, registry: DataFrame, title: str, lid: str, url: str) -> DataFrame:
    """The same mapping against a registry table (id, title, url, conformance) of any size.

    Only the distinct combinations in use are looked up, so a license that a third of the
    documents has is mapped once; the answers go back by equality.
    """
    kinds = df.select(F.col(title).alias("_kt"), F.col(lid).alias("_ki"), F.col(url).alias("_ku")).distinct()
    known = _look_up(kinds, registry)
    on = F.col(title).eqNullSafe(F.col("_kt")) & F.col(lid).eqNullSafe(F.col("_ki")) & F.col(url).eqNullSafe(F.col("_ku"))
    return df.join(known, on, "left").drop("_kt", "_ki", "_ku")


def _look_up(kinds: DataFrame, registry: DataFrame) -> DataFrame:
    """Five left joins of the distinct licenses on unique keys of the registry."""
    lid, title, url = F.col("_ki"), F.col("_kt"), F.col("_ku")
    ids = F.try_element_at(_table({k: v for k, v in ID_ALIASES.items() if v}), lid)
    titles = F.try_element_at(_table({k: v for k, v in TITLE_ALIASES.items() if v}), title)
    out = kinds.withColumns({"_a": F.coalesce(ids, lid), "_t": F.coalesce(titles, title)})
    for key, name, on in [
        ("id", "_by_id", "_a"), ("id", "_by_title_id", "_t"), ("title", "_by_title", "_t"), ("url", "_by_url", "_ku"),
    ]:
        side = registry.where(filled(F.col(key))).groupBy(F.col(key).alias("_key")).agg(F.min("id").alias(name))
        out = out.join(side, out[on] == side["_key"], "left").drop("_key")
    mapped = F.coalesce(
        F.when(filled(lid), F.col("_by_id")),
        F.when(filled(title), F.coalesce("_by_title_id", "_by_title")),
        F.when(filled(url), F.col("_by_url")),
        _some(lid),
        _some(title),
        url,
    )
    out = out.select("_kt", "_ki", "_ku", mapped.alias("license"))
    conf = registry.select(F.col("id").alias("_id"), F.col("conformance").alias("_c"))
    out = out.join(conf, out["license"] == conf["_id"], "left")
    return out.select("_kt", "_ki", "_ku", "license", F.coalesce("_c", F.lit(NOT_FOUND)).alias("conformance"))
