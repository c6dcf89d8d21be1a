"""The merge of each territory by its published policy, over records made from the orders.

Every customer's orders are the records of one program or of several, by construction: the
clusters are read off the generator, not computed by matching. A customer is of one of four
classes: 0 similar titles in one place, 1 a shared number, 2 equal secondary keys within a
source, 3 records that name the number in their link.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.plans.merge import merge_territory
from harrow.plans.policies import POLICIES, SOURCE_KEYS
from registry.bindings import cte, frame
from registry.core import micros, norm, query, strip_html


@dataclass(frozen=True)
class Territory:
    """How the generator fills a territory's sources.

    sources: name -> how its key is made (number, pair, link, title or row).
    natives: source -> its own column -> generator column. fields: policy field -> its SQL.
    seconds: sources with a secondary key. numbered: sources that have the number. named: the
    link that names it. split: what keeps titles in one place apart; kind: the kind of a record.
    """

    sources: dict[str, str]
    natives: dict[str, dict[str, str]]
    fields: dict[str, str]
    seconds: tuple[str, ...] = ()
    numbered: tuple[str, ...] = ()
    named: str | None = None
    split: str = "''"
    kind: str = "''"
    extra: dict[str, str] = field(default_factory=dict)
    amount: tuple[str, str] = ("", "")


_TEXT = "concat('<p>', priority, '</p>', CASE WHEN k % 2 = 0 THEN '<br>  more' ELSE '' END)"
_CLOSE = "substr(cast(published_at + INTERVAL 30 DAY AS STRING), 1, 10)"
_WHOLE = "cast(k % 100000 AS STRING)"
_ENGLISH = (f"concat('$', {_WHOLE}, '.50')", "(k % 100000) + 1.0")

TERRITORIES = {
    "us": Territory(
        sources={"grants_gov_detail": "numbered_row", "grants_gov_search2": "number", "usda_hq_rss": "pair", "fns_rss": "pair"},
        natives={
            "grants_gov_detail": {"opportunityNumber": "number", "agencyCode": "agency_code", "postDate": "twin", "opportunitySynopsisURL": "url", "opportunityAdditionalInfoURL": "blank"},
            "grants_gov_search2": {"number": "number", "id": "pair", "agencyCode": "agency_code", "openDate": "twin"},
            "usda_hq_rss": {"guid": "pair", "link": "url"},
            "fns_rss": {"guid": "pair", "link": "url"},
        },
        fields={
            "opportunity_number": "nullif(number, '')",
            "agency_code": "CASE WHEN cls = 0 AND official THEN concat('AG', cast(g AS STRING)) ELSE '' END",
            "post_date": _CLOSE,
            "close_date": _CLOSE,
            "opp_status": "state",
            "aln_list": "array(priority)",
            "funding_category": "concat('cat', cast(k % 5 AS STRING))",
            "eligibilities": "array(concat('e', cast(k % 4 AS STRING)), concat('e', cast(k % 6 AS STRING)))",
            "estimated_funding": _ENGLISH[0],
            "expected_awards": "cast(k % 50 AS INT)",
            "synopsis_url": "url",
            "description": _TEXT,
        },
        seconds=("grants_gov_detail", "grants_gov_search2", "fns_rss"),
        numbered=("grants_gov_detail", "grants_gov_search2"),
        named="concat('https://www.grants.gov/search-results-detail/', cast(g AS STRING), '?utm_source=', cast(k AS STRING))",
        split="cast(official AS STRING)",
        amount=("estimated_funding", _ENGLISH[1]),
    ),
    "br": Territory(
        sources={"portal_transparencia": "pair", "mapa_news": "pair", "bndes_news": "link"},
        natives={
            "portal_transparencia": {"id": "pair", "programa": "title", "codigo": "pair", "data": "twin", "valor": "blank", "orgao": "twin", "municipio": "blank", "link": "url"},
            "mapa_news": {"guid": "pair", "link": "url"},
            "bndes_news": {"link": "url"},
        },
        fields={
            "seen_at": "published_at",
            "program_name": "title",
            "program_url": "url",
            "description": _TEXT,
            "status": "state",
            "deadline": _CLOSE,
            "funding_amount_brl": f"concat('R$ ', {_WHOLE}, ',25')",
            "beneficiary_count": "cast(k % 50 AS INT)",
            "jurisdiction": "CASE WHEN k % 3 = 0 THEN 'estadual' ELSE '' END",
            "contact": "CASE WHEN k % 4 > 0 THEN concat('c', cast(k AS STRING)) END",
            "document_refs": "array(concat('d', cast(k % 5 AS STRING)))",
        },
        seconds=("portal_transparencia", "bndes_news"),
        kind="CASE WHEN k % 3 = 0 THEN 'estadual' ELSE 'federal' END",
        amount=("funding_amount_brl", "(k % 100000) + 0.25"),
    ),
    "cl": Territory(
        sources={"chilecompra": "pair", "presupuesto_abierto": "pair", "fia_calls": "link", "minagri_news": "pair"},
        natives={
            "chilecompra": {"CodigoExterno": "pair", "Numero": "blank", "CodigoLicitacion": "blank", "CodigoOrdenCompra": "blank", "RutUnidadCompradora": "twin", "Descripcion": "title", "Estado": "blank", "FechaCreacion": "blank", "Link": "url", "URL": "blank"},
            "presupuesto_abierto": {"id": "pair", "codigo_institucion": "blank", "codigo_programa": "blank", "id_transaccion": "blank", "nombre_institucion": "twin", "nombre_programa": "title", "mes": "blank", "anio": "blank", "html_url": "url", "api_url": "blank"},
            "fia_calls": {"link": "url"},
            "minagri_news": {"guid": "pair", "link": "url"},
        },
        fields={"deadline": _CLOSE, "amount_local": f"concat('$', {_WHOLE}, ',25')", "status": "state", "description": _TEXT},
        seconds=("chilecompra", "presupuesto_abierto", "fia_calls"),
        kind="CASE WHEN k % 2 = 0 THEN 'call:convocatoria' ELSE 'news:announcement' END",
        extra={"record_type": "CASE WHEN k % 2 = 0 THEN 'call:convocatoria' ELSE 'news:announcement' END"},
        amount=("amount_local", "(k % 100000) * 1.0"),
    ),
    "nz": Territory(
        sources={"gets_tender": "number_or_title", "mpi_rss": "pair", "beehive_rss": "pair"},
        natives={
            "gets_tender": {"RFx_ID": "number", "organisation": "pair", "Open_Date": "twin", "detail_url": "url"},
            "mpi_rss": {"guid": "pair", "link": "url"},
            "beehive_rss": {"guid": "pair", "link": "url"},
        },
        fields={"publisher": "concat('by ', source)", "close_date": f"CASE WHEN cls = 2 AND official THEN '2030-01-01' ELSE {_CLOSE} END", "status": "state", "funding_amount_nzd": _ENGLISH[0], "description": _TEXT},
        seconds=("gets_tender", "beehive_rss"),
        numbered=("gets_tender",),
        named="concat('https://www.gets.govt.nz/x?id=', cast(g AS STRING), '&utm_source=', cast(k AS STRING))",
        amount=("funding_amount_nzd", _ENGLISH[1]),
    ),
    "au": Territory(
        sources={"rss": "pair", "grantconnect": "link", "state": "link"},
        natives={"rss": {"guid": "pair", "link": "url"}, "grantconnect": {"href": "url"}, "state": {"href": "url"}},
        fields={"status": "state", "deadline": _CLOSE, "funding_amount": _ENGLISH[0], "description": _TEXT},
        amount=("funding_amount", "(k % 100000) + 0.5"),
    ),
}

# What follows from the fields by name in every territory.
_TIMES = ("published_at", "seen_at")
_LISTS = ("aln_list", "eligibilities", "document_refs")


def _records(t: Territory) -> str:
    """The records, in SQL that reads the same in Spark and in the oracle."""
    n = len(t.sources)
    source = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(t.sources))
    official = ", ".join(f"'{s}'" for s in t.numbered) or "''"
    usual = "concat('http://', CASE WHEN cls = 0 THEN concat('c', cast(g % 20 AS STRING)) ELSE concat('h', pair) END, '.Example.org/a/', pair, CASE WHEN n % 2 = 0 THEN '/b' ELSE '' END, '?utm_source=', cast(k AS STRING))"
    link = f"CASE WHEN cls = 3 AND NOT official THEN {t.named} ELSE {usual} END" if t.named else usual
    fields = "".join(f", {sql} AS {name}" for name, sql in {**t.fields, **t.extra}.items())
    return f"""
SELECT *{fields} FROM (SELECT *, {link} AS url FROM (
 SELECT *, source IN ({official}) AS official, CASE WHEN cls IN (1, 3) AND source IN ({official}) THEN cast(g AS STRING) ELSE '' END AS number,
   CASE cls WHEN 0 THEN concat('Fund  ', md5(cast(g AS STRING)), CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 's' ELSE ' x' END)
     WHEN 2 THEN concat('Twin ', md5(cast(g AS STRING))) ELSE concat('Item ', md5(cast(k AS STRING))) END AS title,
   CASE WHEN cls = 2 THEN concat('s', cast(g AS STRING)) ELSE concat('u', cast(k AS STRING)) END AS twin, '' AS blank
 FROM (SELECT *, CASE n % {n} {source} END AS source, concat('r', lpad(cast(k AS STRING), 9, '0')) AS record_id,
   concat(cast(g AS STRING), '-', cast(cast(floor(n / {2 * n}) * {n} + n % {n} AS BIGINT) AS STRING)) AS pair
  FROM (SELECT o_orderkey AS k, o_custkey AS g, o_custkey % 4 AS cls, o_orderdate AS published_at, o_orderpriority AS priority, o_orderstatus AS state,
   row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM {{orders}}) a) b) c) d
"""


def _pick(value: str, where: str, order: str) -> str:
    return f"first({value} ORDER BY {order}) FILTER (WHERE {where})"


_NEWEST = "published_at IS NULL, published_at DESC"
_DEPTH = "len(list_filter(string_split(regexp_extract({0}, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> ''))"


def _rule_sql(v: str, rule, text: bool) -> str:
    ok = f"coalesce({v}, '') <> ''" if text else f"{v} IS NOT NULL"
    seen = f"length({strip_html(v)})"
    if not isinstance(rule, str):
        own = "CASE source " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(rule)) + " END"
        return _pick(v, f"{ok} AND {own} IS NOT NULL", f"{own}, published_at IS NULL, published_at, record_id")
    return {
        "latest_by_precedence": _pick(v, ok, f"rank, {_NEWEST}, record_id"),
        "earliest_by_precedence": _pick(v, ok, f"rank, {v}, record_id"),
        "max_by_precedence": _pick(v, ok, f"rank, {v} DESC, record_id"),
        "first_non_null_by_precedence": _pick(v, ok, "rank, record_id"),
        "longest_by_precedence": _pick(v, ok, f"rank, length({v}) DESC, {v}"),
        "richest_html_by_precedence": _pick(v, ok, f"rank, {seen} DESC, record_id"),
        "earliest_non_null": f"min({v}) FILTER (WHERE {ok})",
        "latest_crawl": f"max({v}) FILTER (WHERE {ok})",
        "prefer_deepest_path": _pick(v, ok, f"{_DEPTH.format(v)} DESC, length({v}) DESC, {v}"),
        "latest_by_date": _pick(v, ok, f"{_NEWEST}, rank, record_id"),
        "max_by_date": _pick(v, ok, f"{_NEWEST}, {v} DESC, record_id"),
        "richest_html_by_date": _pick(v, ok, f"{_NEWEST}, {seen} DESC, record_id"),
        "union_unique": f"array_to_string(list_sort(list_distinct(flatten(list({v})))), '|')",
    }[rule]


def _clean(c: str) -> str:
    return norm(strip_html(c)).removeprefix("lower(").removesuffix(")")


def _merge_sql(name: str) -> str:
    t, policy = TERRITORIES[name], POLICIES[name.upper()]
    key = {
        "pair": "pair",
        "link": "url_key",
        "row": "record_id",
        "numbered_row": "coalesce(nullif(number, ''), record_id)",
        "number": "coalesce(nullif(number, ''), pair)",
        "number_or_title": f"coalesce(nullif(number, ''), {norm('title')} || '|' || pair)",
    }
    keys = "CASE source " + " ".join(f"WHEN '{s}' THEN {key[how]}" for s, how in t.sources.items()) + " END"
    days = ", ".join(f"'{s}'" for s in policy.day_sources) or "''"
    seconds = ", ".join(f"'{s}'" for s in t.seconds) or "''"
    rank = "CASE source " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(policy.precedence)) + " END"
    link = "url"
    if name == "us":  # its list of grants has no link of its own
        link = "CASE WHEN source <> 'grants_gov_search2' THEN url WHEN number <> '' THEN 'https://www.grants.gov/search-results-detail/' || number END"
    named = "bool_or(official) OVER (PARTITION BY g)" if t.named else "false"
    sub = f"""CASE WHEN cls = 0 THEN 'title' || {t.split} WHEN cls = 2 AND source IN ({seconds}) THEN source WHEN cls = 2 THEN pair
      WHEN cls = 1 AND official THEN 'number' WHEN cls = 3 AND {named} THEN 'number' ELSE record_id END || {t.kind}"""
    shown = {c: _clean(c) if c in policy.cleaned else c for c in ("title", *t.fields)}
    shown[t.amount[0]] = t.amount[1]
    shown.pop("link", None)
    columns = ", ".join(f"{sql} AS {c}" for c, sql in shown.items() if sql != c)
    replaced = f"* REPLACE ({columns})"
    types = {"expected_awards", "beneficiary_count", t.amount[0], *_TIMES}
    fields = {c: r for c, r in policy.fields.items()}
    out = []
    for c, r in fields.items():
        sql = _rule_sql(c, r, c not in types)
        out.append(f"{f'epoch_us({sql})' if c in _TIMES else f'CAST({sql} AS DOUBLE)' if c in types else sql} AS {c}")
    known = ("title", "link", "published_at", *t.fields)
    audited = [c for c in policy.audited if c in known]
    cast = {c: f"array_to_string({c}, '|')" if c in _LISTS else c for c in audited}
    changes = " + ".join(f"CAST(n_th > 1 AND {v} IS DISTINCT FROM lag({v}) OVER w AS INT)" for v in cast.values())
    return f"""{cte(raw=_records(t).replace('array(', 'list_value('))}, linked AS (SELECT *, {link} AS link,
   regexp_replace(url, '\\?utm_source=.*$', '') AS url_key FROM raw),
 kept AS (SELECT {replaced}, {rank} AS rank FROM linked QUALIFY row_number() OVER (
   PARTITION BY source, {keys}, CASE WHEN source IN ({days}) THEN date_trunc('day', published_at) END ORDER BY published_at DESC, record_id) = 1),
 labelled AS (SELECT *, {sub} AS sub FROM kept),
 r AS (SELECT *, min(record_id) OVER (PARTITION BY g, sub) AS cluster FROM labelled),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY published_at, record_id) AS n_th FROM r),
 changed AS (SELECT cluster, {changes} AS c FROM numbered WINDOW w AS (PARTITION BY cluster ORDER BY published_at, record_id)),
 totals AS (SELECT cluster, CAST(sum(c) AS BIGINT) AS n_changes FROM changed GROUP BY 1)
SELECT r.cluster, count(*) AS n_records, count(DISTINCT link) AS n_alternates, any_value(n_changes) AS n_changes, {', '.join(out)}
FROM r JOIN totals USING (cluster) GROUP BY r.cluster"""


def _merged(spark, d, name):
    t, policy = TERRITORIES[name], POLICIES[name.upper()]
    base = frame(spark, d, _records(t))
    sources = {}
    for s, natives in t.natives.items():
        own = base.filter(F.col("source") == s)
        columns = {c: F.col(c) for c in ("record_id", "title", "published_at", *t.fields, *t.extra)}
        columns |= {native: F.col(c) for native, c in natives.items()}
        sources[s] = own.select(*[c.alias(n) for n, c in columns.items()])
    merged = merge_territory(sources, policy, SOURCE_KEYS)
    alternates = merged.alternates.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_alternates"))
    changes = merged.history.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_changes"))
    out = merged.records.join(alternates, "cluster", "left").join(changes, "cluster", "left")
    shown = []
    for f in out.schema.fields:
        c = F.col(f.name)
        if f.name in ("n_alternates", "n_changes"):
            c = F.coalesce(c, F.lit(0).cast("bigint"))
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(f.name, "|")
        elif f.name in _TIMES:
            c = micros(f.name)
        elif isinstance(f.dataType, (T.DecimalType, T.IntegerType)):
            c = c.cast("double")
        shown.append(c.alias(f.name))
    return out.select(*shown)


def _register(name: str) -> None:
    @query(f"merge_{name}", _merge_sql(name))
    def merged(spark, d):
        return _merged(spark, d, name)


for _name in TERRITORIES:
    _register(_name)
