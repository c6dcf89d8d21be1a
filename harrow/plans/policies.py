"""Record keys and merge policies by territory."""

from __future__ import annotations

from harrow.plans.merge import Policy, SourceKey

# How each source identifies its records.
SOURCE_KEYS = {
    # US
    "grants_gov_search2": SourceKey(
        ids=("number", "id"),
        second={"title": "text", "agencyCode": "text", "openDate": "text"},
        urls=(),
        template="https://www.grants.gov/search-results-detail/{number}",
        number="number",
    ),
    "grants_gov_detail": SourceKey(
        ids=("opportunityNumber",),
        second={"title": "text", "agencyCode": "text", "postDate": "text"},
        urls=("opportunitySynopsisURL", "opportunityAdditionalInfoURL"),
        number="opportunityNumber",
    ),
    "usda_hq_rss": SourceKey(("guid",), {"link": "url", "title": "text"}, by_day=True),
    "fns_rss": SourceKey(("guid",), {"link": "url"}, {"title": "text"}),
    "rd_rss": SourceKey(("guid",), {"link": "url"}),
    "ars_rss": SourceKey(("guid",), {"link": "url"}),
    "nass_rss": SourceKey(("guid",), {"link": "url"}),
    "fs_rss": SourceKey(("guid",), {"link": "url"}),
    # BR
    "portal_transparencia": SourceKey(
        ("id",),
        {"programa": "text", "codigo": "text", "data": "text", "valor": "raw"},
        {"orgao": "text", "municipio": "text", "data": "text"},
    ),
    "mapa_news": SourceKey(("guid",), {"link": "url", "title": "text"}, by_day=True),
    "bndes_news": SourceKey((), {"link": "url"}, {"title": "text"}),
    # NZ
    "mpi_rss": SourceKey(("guid",), {"link": "url", "title": "text"}, by_day=True),
    "beehive_rss": SourceKey(("guid",), {"link": "url"}, {"title": "text"}),
    "gets_tender": SourceKey(
        ("RFx_ID",),
        {"title": "text", "organisation": "text"},
        {"Open_Date": "raw", "Close_Date": "raw", "title": "text"},
        urls=("detail_url",),
        number="RFx_ID",
    ),
    # CL
    "chilecompra": SourceKey(
        ids=("CodigoExterno", "Numero", "CodigoLicitacion", "CodigoOrdenCompra"),
        second={
            "RutUnidadCompradora": "text",
            "Descripcion": "text",
            "Estado": "text",
            "FechaCreacion": "text",
        },
        urls=("Link", "URL"),
    ),
    "presupuesto_abierto": SourceKey(
        ("id",),
        {"codigo_institucion": "raw", "codigo_programa": "raw", "id_transaccion": "raw"},
        {"nombre_institucion": "text", "nombre_programa": "text", "mes": "raw", "anio": "raw"},
        urls=("html_url", "api_url"),
    ),
    "minagri_news": SourceKey(("guid",), {"link": "url", "title": "text"}, by_day=True),
    "fia_calls": SourceKey((), {"link": "url"}, {"title": "text"}),
    # AU
    "rss": SourceKey(("guid",), {"link": "url"}),
    "grantconnect": SourceKey((), {"href": "url"}, urls=("href",)),
    "state": SourceKey((), {"href": "url"}, urls=("href",)),
}

_SHORT_TRACKING = ("utm_source", "utm_medium", "utm_campaign", "gclid", "fbclid")
_GRANTS = ("grants_gov_detail", "grants_gov_search2")

# The newest publish date decides, whatever the source.
LATEST_PUBLISH_FIELDS = {
    "title": "latest_by_date",
    "status": "latest_by_date",
    "deadline": "earliest_non_null",
    "funding_amount": "max_by_date",
    "description": "richest_html_by_date",
    "link": "prefer_deepest_path",
}

POLICIES = {
    "US": Policy(
        precedence=(
            "grants_gov_detail", "grants_gov_search2", "usda_hq_rss", "fns_rss", "rd_rss",
            "ars_rss", "nass_rss", "fs_rss",
        ),
        fields={
            "opportunity_number": _GRANTS,
            "title": "latest_by_precedence",
            "agency_code": _GRANTS,
            "published_at": "earliest_by_precedence",
            "post_date": _GRANTS,
            "close_date": "earliest_non_null",
            "opp_status": "latest_by_precedence",
            "aln_list": "union_unique",
            "funding_category": _GRANTS,
            "eligibilities": "union_unique",
            "estimated_funding": "max_by_precedence",
            "expected_awards": "max_by_precedence",
            "synopsis_url": "prefer_deepest_path",
            "description": "richest_html_by_precedence",
        },
        threshold=0.88,
        id_pattern=r"grants\.gov/search-results-detail/([A-Za-z0-9-]+)",
        day_sources=("usda_hq_rss",),
        aliases={
            "www.grants.gov": "grants.gov",
            "www.usda.gov": "usda.gov",
            "www.fns.usda.gov": "fns.usda.gov",
            "www.rd.usda.gov": "rd.usda.gov",
        },
        block=("agency_code", "host"),
        money={"estimated_funding": ("en-US", 0)},
        cleaned=("title", "description"),
        audited=("title", "opp_status", "close_date", "estimated_funding", "eligibilities", "description"),
    ),
    "BR": Policy(
        precedence=("portal_transparencia", "mapa_news", "bndes_news"),
        fields={
            "published_at": "earliest_by_precedence",
            "seen_at": "latest_crawl",
            "program_name": "longest_by_precedence",
            "program_url": "prefer_deepest_path",
            "description": "richest_html_by_precedence",
            "status": "latest_by_precedence",
            "deadline": "earliest_non_null",
            "funding_amount_brl": "max_by_precedence",
            "beneficiary_count": "max_by_precedence",
            "jurisdiction": "first_non_null_by_precedence",
            "contact": "first_non_null_by_precedence",
            "document_refs": "union_unique",
        },
        threshold=0.86,
        kinds={"jurisdiction": "federal"},
        day_sources=("mapa_news",),
        money={c: ("pt-BR", 2) for c in ("funding_amount_brl", "valor", "valorEmprestimo")},
        audited=("title", "description", "status", "funding_amount_brl", "deadline"),
    ),
    "NZ": Policy(
        precedence=("gets_tender", "mpi_rss", "beehive_rss"),
        fields={
            "title": "latest_by_precedence",
            "publisher": ("gets_tender", "mpi_rss", "beehive_rss"),
            "published_at": "earliest_by_precedence",
            "close_date": "earliest_non_null",
            "status": "latest_by_precedence",
            "funding_amount_nzd": "max_by_precedence",
            "description": "richest_html_by_precedence",
            "link": "prefer_deepest_path",
        },
        threshold=0.88,
        id_pattern=r"(?i)(?:[?&]id=|\bRFx(?: ID)?[ :#]*)(\d+)",
        day_sources=("mpi_rss",),
        aliases={
            "www.mpi.govt.nz": "mpi.govt.nz",
            "www.beehive.govt.nz": "beehive.govt.nz",
            "www.gets.govt.nz": "gets.govt.nz",
        },
        tracking=_SHORT_TRACKING,
        money={c: ("en-NZ", 0) for c in ("funding_amount_nzd", "Awarded_Amount")},
        cleaned=("title", "description"),
        audited=("title", "status", "close_date", "funding_amount_nzd", "description"),
    ),
    "CL": Policy(
        precedence=("chilecompra", "presupuesto_abierto", "fia_calls", "minagri_news"),
        fields={
            "published_at": ("chilecompra", "presupuesto_abierto", "fia_calls", "minagri_news"),
            "deadline": ("fia_calls", "minagri_news", "chilecompra"),
            "amount_local": ("presupuesto_abierto", "chilecompra"),
            "status": ("chilecompra", "fia_calls", "minagri_news"),
            "description": ("fia_calls", "minagri_news", "chilecompra"),
        },
        threshold=0.86,
        kinds={"jurisdiction": "Chile", "record_type": ""},
        day_sources=("minagri_news",),
        aliases={"www.fia.cl": "fia.cl", "minagri.gob.cl": "www.minagri.gob.cl"},
        money={
            c: ("es-CL", 0)
            for c in ("amount_local", "MontoEstimado", "MontoTotal", "monto", "monto_devengado", "monto_pagado")
        },
        cleaned=("title", "description"),
        audited=("title", "status", "deadline", "amount_local", "description"),
    ),
    "AU": Policy(
        precedence=("rss", "grantconnect", "state"),
        fields=LATEST_PUBLISH_FIELDS,
        threshold=0.88,
        money={"funding_amount": ("en-AU", 2)},
        audited=("title", "status", "deadline", "funding_amount"),
    ),
}
