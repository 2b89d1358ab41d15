"""Queries on filtering and joining hazard areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, relations, summaries
from ..operators.area_metrics import area_metrics, with_rank
from ..operators.catalogue import area_polygons
from ..session import fresh_path, staged
from ..sources.area_files import AREA_COLUMNS, read_areas
from ..sources.sql import read_sql
from .geography import METRIC_SQL, POLYGON_TEXT, millimetres, polygons
from .inputs import AREAS, derive, plain
from .registry import query

AREA_SQL = plain(AREAS)
COLUMNS = ", ".join(AREA_COLUMNS)


@query(
    "area_regex_filter",
    f"""select floodarea_id, {COLUMNS} from ({AREA_SQL}) a
        where regexp_matches(county, 'NATION_[12]') and regexp_matches(description, '^(red|blue) .*') and eaareaname is not null
          and label is not null and riverorsea is not null and fwdcode is not null""",
)
def area_regex_filter(spark, sf_dir):
    rows = filters.areas_by_regex(derive(spark, sf_dir, AREAS), county="NATION_[12]", description="^(red|blue) .*")
    return rows.select("floodarea_id", *AREA_COLUMNS)


@query(
    "area_ilike_filter",
    f"""select floodarea_id, {COLUMNS} from ({AREA_SQL}) a
        where county ilike '%nation_1%' and description ilike '%SM__L%' and riverorsea ilike '%brand%'""",
)
def area_ilike_filter(spark, sf_dir):
    rows = filters.areas_like(
        derive(spark, sf_dir, AREAS), county="nation_1", description="SM__L", riverorsea="br\\and", label=""
    )
    return rows.select("floodarea_id", *AREA_COLUMNS)


@query("area_ilike_all", f"select floodarea_id, {COLUMNS} from ({AREA_SQL}) a where county is not null")
def area_ilike_all(spark, sf_dir):
    return filters.areas_like(derive(spark, sf_dir, AREAS)).select("floodarea_id", *AREA_COLUMNS)


@query(
    "area_multiselect",
    f"""select floodarea_id, {COLUMNS} from ({AREA_SQL}) a
        where eaareaname in ('ASIA', 'EUROPE') and label ilike '%red%' and county is not null""",
)
def area_multiselect(spark, sf_dir):
    rows = filters.areas_selected(derive(spark, sf_dir, AREAS), ["ASIA", "EUROPE"], label="red")
    return rows.select("floodarea_id", *AREA_COLUMNS)


VIEW = (51.0, -3.5, 53.25, -1.0)


@query(
    "area_viewport",
    f"select floodarea_id, lat, long from ({AREA_SQL}) a where lat between 51.0 and 53.25 and long between -3.5 and -1.0",
)
def area_viewport(spark, sf_dir):
    return filters.in_viewport(derive(spark, sf_dir, AREAS), *VIEW).select("floodarea_id", "lat", "long")


@query(
    "area_facets",
    f"""select eaareaname, eaareaname in (select eaareaname from ({AREA_SQL}) b where county ilike '%nation_1%') as active
        from (select distinct eaareaname from ({AREA_SQL}) a) d""",
)
def area_facets(spark, sf_dir):
    areas = derive(spark, sf_dir, AREAS)
    return summaries.facets(areas, filters.areas_like(areas, county="nation_1"), "eaareaname")


FACETS = {
    "eaareaname": "eaareaname in ('ASIA', 'EUROPE', 'AMERICA')",
    "county": "county ilike '%nation_1%'",
    "description": "description ilike '%e%'",
    "label": None,
    "riverorsea": "riverorsea ilike '%1%'",
    "fwdcode": "fwdcode not ilike '%77%'",
}


def _facet_sql(facet: str) -> str:
    others = " and ".join(f"coalesce({sql}, false)" for name, sql in FACETS.items() if sql and name != facet)
    own = f"coalesce({FACETS[facet]}, false)" if FACETS[facet] else "true"
    return f"""select '{facet}' as facet, {facet} as value, count(*) as n_rows, count(*) filter (where {others}) as n_left,
        count(*) filter (where {others} and {own}) as n_active
        from ({AREA_SQL}) a where {facet} is not null group by {facet}"""


@query("area_facet_counts", " union all ".join(_facet_sql(facet) for facet in FACETS))
def area_facet_counts(spark, sf_dir):
    """All values of the six area fields, under filters on five of them."""
    conditions = {name: sql and F.expr(sql) for name, sql in FACETS.items()}
    return summaries.facet_counts(derive(spark, sf_dir, AREAS), conditions)


@query("area_filtered_count", f"select count(*) as n_rows from ({AREA_SQL}) a where county ilike '%nation_1%'")
def area_filtered_count(spark, sf_dir):
    return summaries.row_count(filters.areas_like(derive(spark, sf_dir, AREAS), county="nation_1"))


@query("area_catalogue", f"select eaareaname, county, description, label, fwdcode from ({AREA_SQL}) a")
def area_catalogue(spark, sf_dir):
    return relations.catalogue_columns(derive(spark, sf_dir, AREAS))


@query("area_listing", f"select county, fwdcode, lat, long from ({AREA_SQL}) a")
def area_listing(spark, sf_dir):
    return relations.listing_columns(derive(spark, sf_dir, AREAS))


@query("area_csv_scan", f"select {COLUMNS} from ({AREA_SQL}) a")
def area_csv_scan(spark, sf_dir):
    path = fresh_path(spark, "area-file")
    derive(spark, sf_dir, AREAS).select(*AREA_COLUMNS).write.option("header", True).csv(path)
    return read_areas(spark, path)


@query(
    "parameterized_sql",
    f"select floodarea_id, county, label from ({AREA_SQL}) a where county ilike '%tion_2%' and label ilike '%bolt%'",
)
def parameterized_sql(spark, sf_dir):
    return read_sql(
        spark,
        "select floodarea_id, county, label from {areas} where county ilike :county and label ilike :label",
        {"county": "%tion_2%", "label": "%bolt%"},
        areas=derive(spark, sf_dir, AREAS),
    )


@query(
    "area_view",
    f"""with m as (select *, rank() over (order by area_m2 desc) as rank from ({METRIC_SQL}) k)
        select a.floodarea_id, a.fwdcode, a.eaareaname, a.county, a.description, a.label, a.riverorsea,
          p.lat, p.long, cast(floor(round(m.bcen_e, 6) * 1000 + 0.3) as bigint) as bcen_bng_long_mm, cast(floor(round(m.bcen_n, 6) * 1000 + 0.3) as bigint) as bcen_bng_lat_mm,
          round(m.area_m2, 1) as area_m2, m.rank, p.polygon_json
        from ({AREA_SQL}) a
        left join (select a2.floodarea_id, a2.lat, a2.long, t.polygon_json from ({AREA_SQL}) a2
          join ({POLYGON_TEXT}) t on t.fwdcode = a2.fwdcode where t.polygon_json is not null) p on p.floodarea_id = a.floodarea_id
        left join m on m.floodarea_id = a.floodarea_id""",
)
def area_view(spark, sf_dir):
    null_point = F.lit(None).cast("struct<srid:int,x:double,y:double>")
    areas = derive(spark, sf_dir, AREAS).withColumns({"geom4326": null_point, "geom27700": null_point})
    documents = polygons(spark, sf_dir)
    # measured once per document: a code is cut to five digits, so that many areas may share the documents of one
    metrics = with_rank(staged(area_metrics(documents), "metrics"))
    texts = documents.select("fwdcode", "polygon_json")
    view = relations.area_view(areas, lambda rows, also: area_polygons(rows, texts, "left", also), metrics)
    return view.select(
        "floodarea_id", "fwdcode", "eaareaname", "county", "description", "label", "riverorsea", "lat", "long",
        millimetres("bcen_bng_long"),
        millimetres("bcen_bng_lat"),
        F.round("area_m2", 1).alias("area_m2"),
        "rank",
        "polygon_json",
    )
