"""A self-contained page of citations for people, and the report of a run."""

from __future__ import annotations

import json
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACETS = ("economy", "indicator_id", "review_status", "currency_status")
_SCRIPT = (
    "const q=document.getElementById('q'),fs=[...document.querySelectorAll('select')];function show(){const t=q.value.toLowerCase();"
    "for(const c of document.querySelectorAll('.c')){const ok=(!t||c.textContent.toLowerCase().includes(t))&&fs.every(f=>!f.value||c.dataset[f.name]===f.value);c.hidden=!ok}}"
    "q.oninput=show;for(const f of fs)f.onchange=show;"
)


def _card(r: dict) -> str:
    data = " ".join(f'data-{f.replace("_", "")}="{escape(str(r.get(f) or ""))}"' for f in FACETS)
    place = " · ".join(escape(str(r[k])) for k in ("economy", "law_name", "article", "indicator_id") if r.get(k))
    link = f' <a href="{escape(r["source_url"])}">source</a>' if str(r.get("source_url") or "").startswith(("http://", "https://")) else ""
    return f'<article class="c" {data}><h2>{place}</h2><blockquote>{escape(r.get("quote") or "")}</blockquote><p>{escape(r.get("rationale") or "")}{link}</p></article>'


def page(citations: DataFrame, title: str) -> str:
    """HTML with facets and a search box; for as many citations as a person looks at."""
    rows = [r.asDict() for r in citations.toLocalIterator()]
    have = [f for f in FACETS if f in citations.columns]
    choices = "".join(
        f'<select name="{f.replace("_", "")}"><option value="">{escape(f)}</option>' + "".join(f"<option>{escape(v)}</option>" for v in sorted({str(r[f]) for r in rows if r[f]})) + "</select>"
        for f in have
    )
    cards = "".join(_card(r) for r in rows)
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><input id="q">{choices}{cards}<script>{_SCRIPT}</script></body></html>'


def summary(citations: DataFrame, by: str = "economy") -> DataFrame:
    """By economy: citations, indicators, new and known, unverified, and how many are of each currency."""
    status = F.coalesce("currency_status", F.lit("UNKNOWN"))
    one = citations.groupBy(by, status.alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("indicator_id").alias("i"), F.count_if(F.col("discovery_tag") == "NEW").alias("new"), F.count_if(F.col("review_status") != "VERIFIED").alias("review")
    )
    return one.groupBy(by).agg(
        F.sum("n").alias("citations"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("i")))), ",").alias("indicators"),
        F.sum("new").alias("new"),
        F.sum("review").alias("review"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "status", F.col("n").cast("string")))), ",").alias("currency"),
    )


def report(citations: DataFrame, facts: dict) -> str:
    """A run's report as JSON."""
    return json.dumps({"run": facts, "economies": [r.asDict() for r in summary(citations).orderBy("economy").collect()]}, indent=2, sort_keys=True)
