"""Queries for effective-dated policy records."""

from pyspark.sql import functions as F

from quaymetrics.operators import policy as PO
from quaymetrics.operators import trade as TD
from quaymetrics.registry import cte, query

TREATED = "3"
PRE_END = "1997-06-30"

cte(
    "baseline_rates",
    """
select substr(hs10, 1, 8) as line, case when year(month_date) in (1996, 1998, 1999) then 0 else 200 end + year(month_date) as year, round(sum(cal_dut_mo) / sum(con_val_mo), 3) as rate
from trade group by 1, 2
""",
)


def baseline_rates(v):
    # the other years' schedules are filed under years that no trade has
    year = F.year("month_date")
    filed = year + F.when(year.isin(1996, 1998, 1999), 0).otherwise(200)
    return (
        v.trade.groupBy(F.substring("hs10", 1, 8).alias("line"), filed.alias("year"))
        .agg(F.round(F.sum("cal_dut_mo") / F.sum("con_val_mo"), 3).alias("rate"))
    )


def assess_sql(keys: str, p: str) -> str:
    """The assessment of a key table, as a chain of named subqueries ending in {p}_law."""
    k = "product, country, as_of"
    return f"""
{p}_live as (select k.product, k.country, k.as_of, r.* exclude (product_code, partner_country_code)
   from (select distinct {k} from {keys}) k join tariff_records r on substr(k.product, 1, 8) = r.product_code and k.country = r.partner_country_code
   and r.effective_date <= k.as_of and (r.expiry_date is null or k.as_of < r.expiry_date)),
{p}_gov as (select * from (select *, row_number() over (partition by {k}, action_id order by effective_date desc, record_id desc) as rn
   from {p}_live where record_type in ('ADDITIONAL_DUTY', 'RATE_CHANGE')) x where rn = 1),
{p}_ex as (select distinct {k} from {p}_live e where record_type = 'EXCLUSION' and not exists (
   select 1 from {p}_live r where r.record_type = 'REINSTATEMENT' and r.product = e.product and r.country = e.country and r.as_of = e.as_of
   and r.action_id = e.action_id and r.effective_date > e.effective_date)),
{p}_sum as (select {k}, count(*) as n, count(distinct ad_valorem_rate) as d, max(ad_valorem_rate) as mx, bool_or(partial_line) as part,
   string_agg(action_id, '|' order by action_id) as acts from {p}_gov group by {k}),
{p}_base as (select k.product, k.country, k.as_of, arg_max(b.rate, b.year) as baseline_rate from (select distinct {k} from {keys}) k
   left join baseline_rates b on b.line = substr(k.product, 1, 8) and b.year <= year(k.as_of) group by 1, 2, 3),
{p}_law as (select k.product, k.country, k.as_of, b.baseline_rate,
   case when s.n is null or e.product is not null then 0.0::double when s.n > 1 and s.d > 1 then null else s.mx end as additional_rate,
   case when s.n is null then 'NO_MATCH' when e.product is not null then 'EXCLUDED' when s.part then 'PARTIAL_LINE'
        when s.n > 1 and s.d > 1 then 'CONFLICT' else 'OK' end as status, coalesce(s.acts, '') as active_actions,
   s.n is not null and e.product is not null as exclusion_active
   from (select distinct {k} from {keys}) k left join {p}_sum s on k.product = s.product and k.country = s.country and k.as_of = s.as_of
   left join {p}_ex e on k.product = e.product and k.country = e.country and k.as_of = e.as_of
   join {p}_base b on k.product = b.product and k.country = b.country and k.as_of = b.as_of)"""


def law_columns() -> str:
    return (
        "product, country, as_of, baseline_rate, additional_rate, baseline_rate + additional_rate as total_rate, status, "
        "case when status = 'CONFLICT' or coalesce(additional_rate, 0) > 0 then 1.0::double else 0.0::double end as coverage_share, active_actions, "
        "exclusion_active, coalesce(additional_rate, 0) > 0 as treated, status in ('OK', 'NO_MATCH', 'EXCLUDED') as usable"
    )


cte("line_keys", "select distinct substr(hs10, 1, 8) as product, country_code as country, month_date + 16 as as_of from trade")


def line_keys(v):
    return v.trade.select(
        F.substring("hs10", 1, 8).alias("product"),
        F.col("country_code").alias("country"),
        F.date_add("month_date", 16).alias("as_of"),
    ).distinct()


@query(
    "J05_valid_facts",
    """
select k.product, k.country, k.as_of, r.record_id, r.action_id, r.ad_valorem_rate from line_keys k
join tariff_records r on k.product = r.product_code and k.country = r.partner_country_code
 and r.effective_date <= k.as_of and (r.expiry_date is null or k.as_of < r.expiry_date)
""",
    "ad_valorem_rate",
)
def _(v):
    return PO.valid_facts(line_keys(v), v.tariff_records).select(
        "product", "country", "as_of", "record_id", "action_id", "ad_valorem_rate"
    )


@query(
    "T01_assess_lines",
    f"with {assess_sql('line_keys', 't')} select {law_columns()} from t_law",
    "baseline_rate additional_rate total_rate coverage_share",
)
def _(v):
    return PO.assess_lines(line_keys(v), v.tariff_records, baseline_rates(v)).drop("source_records")


# Headings of two digits group the twenty lines into tens, so that coverage is mixed.
cte(
    "heading_children",
    """
select lpad(cast(k % 7 as varchar), 6, '0') as hs6, lpad(cast(k as varchar), 6, '0') || '00' as line, w as weight
from (select l_partkey % 20 as k, sum(l_extendedprice) as w from lineitem group by 1) c
""",
)
cte("heading_keys", "select distinct h.hs6, '3' as country, m.month_date as as_of from heading_children h, (select distinct month_date from trade) m")
cte("heading_lines", "select h.hs6, h.country, h.as_of, c.line as product, c.weight from heading_keys h join heading_children c on h.hs6 = c.hs6")


def heading_children(v):
    k = F.col("l_partkey") % 20
    return v.lineitem.groupBy(k.alias("k")).agg(F.sum("l_extendedprice").alias("weight")).select(
        F.lpad((F.col("k") % 7).cast("string"), 6, "0").alias("hs6"),
        F.concat(F.lpad(F.col("k").cast("string"), 6, "0"), F.lit("00")).alias("line"),
        "weight",
    )


def heading_keys(v):
    months = v.trade.agg(F.collect_set("month_date").alias("m")).scalar()
    return heading_children(v).select("hs6").distinct().select(
        "hs6", F.lit(TREATED).alias("country"), F.explode(months).alias("as_of")
    )


@query(
    "T02_assess_headings",
    f"""
with {assess_sql("heading_lines", "t")},
c as (select l.hs6, w.weight, t.*, coalesce(t.additional_rate, 0) > 0 as treated from heading_lines l join t_law t on l.product = t.product and l.country = t.country and l.as_of = t.as_of
      join heading_children w on w.line = l.product and w.hs6 = l.hs6),
a as (select hs6, country, as_of, string_agg(distinct act, '|' order by act) as acts from (select hs6, country, as_of, unnest(string_split(active_actions, '|')) as act from c) u
      where act <> '' group by 1, 2, 3),
g as (select hs6, country, as_of, sum(case when treated then weight else 0 end) / sum(weight) as cov, sum(weight * coalesce(additional_rate, 0)) / sum(weight) as additional_rate,
             case when count(baseline_rate) = count(*) then sum(weight * baseline_rate) / sum(weight) end as baseline_rate, bool_or(status = 'CONFLICT') as cf,
             bool_or(status = 'PARTIAL_LINE') as pt, bool_or(exclusion_active) as exclusion_active from c group by 1, 2, 3)
select g.hs6, g.country, g.as_of, cov as coverage_share, additional_rate, baseline_rate, baseline_rate + additional_rate as total_rate, exclusion_active, coalesce(acts, '') as active_actions,
       case when cf then 'CONFLICT' when cov > 0 and cov < 1 - 1e-12 then 'PARTIAL_HS6_COVERAGE' when pt then 'PARTIAL_LINE' when cov = 0 and exclusion_active then 'EXCLUDED'
            when cov = 0 then 'NO_MATCH' else 'OK' end as status
from g left join a on g.hs6 = a.hs6 and g.country = a.country and g.as_of = a.as_of
""",
    "coverage_share additional_rate baseline_rate total_rate",
)
def _(v):
    return PO.assess_headings(
        heading_keys(v), heading_children(v), v.tariff_records, baseline_rates(v)
    )


# The panel's keys: the 8-digit line, or the full number under partial lines.
cte(
    "month_keys",
    """
select distinct case when substr(hs10, 1, 8) in (select product_code from tariff_records where partial_line) then hs10 else substr(hs10, 1, 8) end as product,
       country_code as country, month_date as month from trade
""",
)
cte(
    "month_segments",
    """
select product, country, month, start as as_of, datediff('day', start, coalesce(lead(start) over (partition by product, country, month order by start), cast(month + interval 1 month as date))) as days
from (select product, country, month, month as start from month_keys
      union select k.product, k.country, k.month, d.day from month_keys k join (
        select product_code, partner_country_code, unnest([effective_date, expiry_date]) as day from tariff_records) d
      on substr(k.product, 1, 8) = d.product_code and k.country = d.partner_country_code and d.day > k.month and d.day < cast(k.month + interval 1 month as date)) s
""",
)
cte(
    "month_law",
    f"""
with {assess_sql("month_segments", "m")}
select s.product, s.country, s.month, arg_max(coalesce(baseline_rate, -1), s.as_of) as base_raw,
       case when count(additional_rate) = count(*) then sum(additional_rate * days) / sum(days) end as additional_tariff_rate,
       case when count(baseline_rate + additional_rate) = count(*) then sum((baseline_rate + additional_rate) * days) / sum(days) end as total_modeled_tariff_rate,
       arg_max(coalesce(additional_rate, -1), s.as_of) as end_raw, arg_min(coalesce(additional_rate, -1), s.as_of) as start_raw,
       count(*) > 1 as tariff_regime_changed_within_month, arg_max(status, s.as_of) as tariff_status, arg_max(active_actions, s.as_of) as active_actions,
       arg_max(exclusion_active, s.as_of) as exclusion_active, arg_max(coalesce(additional_rate, 0) > 0, s.as_of) as treated
from month_segments s join m_law l on s.product = l.product and s.country = l.country and s.as_of = l.as_of group by 1, 2, 3
""",
)
MONTH_LAW = (
    "nullif(base_raw, -1) as baseline_mfn_rate, additional_tariff_rate, total_modeled_tariff_rate, nullif(end_raw, -1) as additional_tariff_rate_month_end, "
    "nullif(start_raw, -1) as additional_tariff_rate_month_start, tariff_regime_changed_within_month, tariff_status, active_actions, exclusion_active, treated"
)
LAW_DIGITS = (
    "baseline_mfn_rate additional_tariff_rate total_modeled_tariff_rate additional_tariff_rate_month_end additional_tariff_rate_month_start"
)


def month_keys(v):
    return v.trade.select(
        F.substring("hs10", 1, 8).alias("product"),
        F.col("country_code").alias("country"),
        F.col("month_date").alias("month"),
    ).distinct()


@query(
    "T03_monthly_rate",
    f"select product, country, month, {MONTH_LAW} from month_law where length(product) = 8",
    LAW_DIGITS,
)
def _(v):
    partial = v.tariff_records.where("partial_line").select(F.col("product_code").alias("product"))
    keys = month_keys(v).join(partial, "product", "left_anti")
    out = PO.monthly_rate(keys, v.tariff_records, baseline_rates(v))
    return out.drop("tariff_coverage_share", "tariff_usable_for_treatment")


cte(
    "assessed_trade",
    """
select t.*, l.* exclude (product, country, month) from trade t join month_law l on l.country = t.country_code and l.month = t.month_date
 and l.product = case when substr(t.hs10, 1, 8) in (select product_code from tariff_records where partial_line) then t.hs10 else substr(t.hs10, 1, 8) end
""",
)


@query(
    "T04_attach_treatment",
    f"select hs10, country_code, month_date, {MONTH_LAW} from assessed_trade",
    LAW_DIGITS,
)
def _(v):
    panel = v.trade.select("hs10", "country_code", "month_date")
    out = PO.attach_treatment(panel, v.tariff_records, baseline=baseline_rates(v))
    return out.drop("tariff_coverage_share", "tariff_usable_for_treatment")


cte(
    "panel",
    """
with b as (
  select hs10, substr(hs10, 1, 6) as hs6, country_code, month_date, con_val_mo as customs_value, con_cha_mo as import_charges, dut_val_mo as dutiable_value,
         cal_dut_mo as calculated_duties, case when unit_qy1 = '-' then null else con_qy1_mo end as quantity, case when unit_qy1 = '-' then '' else unit_qy1 end as quantity_unit,
         nullif(base_raw, -1) as baseline_mfn_rate, additional_tariff_rate, total_modeled_tariff_rate, tariff_status, active_actions, treated,
         tariff_status in ('OK', 'NO_MATCH', 'EXCLUDED') as tariff_usable_for_treatment, year(month_date) * 12 + month(month_date) as month_index
  from assessed_trade),
f as (select hs10, min(month_index) as first_treated_month_index from b where treated group by 1),
s as (select hs10, month_date, sum(customs_value) as tot, count(*) filter (where customs_value > 0) as sup, sum(customs_value * customs_value) / nullif(sum(customs_value) * sum(customs_value), 0) as hhi,
             sum(case when country_code = '3' then customs_value end) / nullif(sum(customs_value), 0) as ts from b group by 1, 2),
p as (select hs10, coalesce(sum(case when country_code = '3' then customs_value end), 0) / nullif(sum(customs_value), 0) as pre from b where month_date <= date '1997-06-30' group by 1)
select b.*, case when quantity > 0 then customs_value / quantity end as customs_unit_value, case when quantity > 0 then (customs_value + calculated_duties) / quantity end as landed_unit_value_duty_inclusive,
       case when dutiable_value > 0 then calculated_duties / dutiable_value end as realised_duty_rate_on_dutiable, first_treated_month_index,
       month_index - first_treated_month_index as event_time, first_treated_month_index is not null as ever_treated_product, tot as product_month_total_value,
       sup as supplier_count_in_sample, hhi as supplier_hhi_in_sample, ts as treated_country_share, customs_value / nullif(tot, 0) as supplier_value_share, 1 - ts as alternative_source_share,
       country_code = '3' as is_treated_country, coalesce(customs_value, 0) > 0 as flow_active,
       coalesce(customs_value, 0) > 0 and not coalesce(lag(coalesce(customs_value, 0) > 0) over w, false) as flow_entry,
       not coalesce(customs_value, 0) > 0 and coalesce(lag(coalesce(customs_value, 0) > 0) over w, false) as flow_exit,
       pre as pretreatment_treated_country_share, case when customs_value > 0 then ln(customs_value) end as log_customs_value, case when quantity > 0 then ln(quantity) end as log_quantity,
       case when quantity > 0 and customs_value > 0 then ln(customs_value / quantity) end as log_customs_unit_value, b.hs10 || '-' || b.country_code as flow_id, strftime(b.month_date, '%Y-%m') as month_key
from b left join f on b.hs10 = f.hs10 left join s on b.hs10 = s.hs10 and b.month_date = s.month_date left join p on b.hs10 = p.hs10
window w as (partition by b.hs10, b.country_code order by b.month_date)
""",
)


def build_panel(v):
    return TD.trade_panel(
        v.trade,
        v.tariff_records,
        TREATED,
        PRE_END,
        baseline=baseline_rates(v),
    )


def panel_view(v):
    """The analytical panel as a stored layer, built once per session and data folder."""
    return v.stored("trade_panel", lambda: build_panel(v))


PANEL_COLUMNS = (
    "hs10, hs6, country_code, month_date, customs_value, quantity, baseline_mfn_rate, additional_tariff_rate, total_modeled_tariff_rate, tariff_status, treated, month_index, "
    "customs_unit_value, realised_duty_rate_on_dutiable, event_time, ever_treated_product, product_month_total_value, supplier_count_in_sample, supplier_hhi_in_sample, "
    "treated_country_share, supplier_value_share, alternative_source_share, is_treated_country, flow_active, flow_entry, flow_exit, pretreatment_treated_country_share, "
    "log_customs_value, log_quantity, log_customs_unit_value, flow_id, month_key"
)


@query(
    "T05_trade_panel",
    f"select {PANEL_COLUMNS} from panel",
    "customs_value:2 quantity:1 baseline_mfn_rate additional_tariff_rate total_modeled_tariff_rate customs_unit_value:3 realised_duty_rate_on_dutiable product_month_total_value:2 "
    "supplier_hhi_in_sample treated_country_share supplier_value_share alternative_source_share pretreatment_treated_country_share log_customs_value log_quantity log_customs_unit_value",
)
def _(v):
    return build_panel(v).select(*PANEL_COLUMNS.split(", "))


@query(
    "T06_baseline_rate",
    """
select k.product, k.year, arg_max(b.rate, b.year) as baseline_rate
from (select distinct substr(hs10, 1, 8) as product, year(month_date) as year from trade) k left join baseline_rates b on b.line = k.product and b.year <= k.year group by 1, 2
""",
    "baseline_rate",
)
def _(v):
    keys = v.trade.select(
        F.substring("hs10", 1, 8).alias("product"), F.year("month_date").alias("year")
    ).distinct()
    return PO.baseline_rate(keys, baseline_rates(v))


@query(
    "T07_classify_products",
    """
with a as (select substr(hs10, 1, 8) as product, string_agg(distinct act, '|' order by act) filter (where act <> '') as actions, bool_or(tariff_status not in ('OK', 'NO_MATCH', 'EXCLUDED')) as bad,
                  bool_or(treated) as tr from (select *, unnest(string_split(active_actions, '|')) as act from panel where country_code = '3') u group by 1),
g as (select product, coalesce(actions, '') as actions, case when actions is null then 'control' when not contains(actions, '|') and tr and not bad then 'treated' else 'ambiguous' end as product_group from a),
r as (select *, row_number() over (partition by product_group order by product) as position from g)
select product, actions, product_group, case when product_group = 'treated' then actions when product_group = 'control' then 'NEVER_TREATED' end as treatment_cohort, position
from r where (position - 1) % 2 = 0
""",
)
def _(v):
    assessed = panel_view(v).where(F.col("country_code") == TREATED).withColumns(
        {"line": F.col("hs8"), "usable": F.col("tariff_usable_for_treatment")}
    )
    return PO.classify_products(assessed, "line", step=2)


@query(
    "T08_hs6_children",
    "select substr(l, 1, 6) as hs6, l as hts8, count(*) over (partition by substr(l, 1, 6)) as n_lines from (select distinct substr(lpad(cast(p_partkey * 7 as varchar), 8, '0'), 1, 8) as l from part) p",
)
def _(v):
    return PO.hs6_children(part_lines(v))


def part_lines(v):
    text = F.lpad((F.col("p_partkey") * 7).cast("string"), 8, "0")
    return v.part.select(text.alias("hts8"))


@query(
    "T08_resolve_truncated",
    """
with l as (select distinct lpad(cast(p_partkey * 7 as varchar), 8, '0') as hts8 from part),
c as (select distinct case when p_size % 15 = 0 then 'x' else '' end || lpad(cast(p_partkey * 7 as varchar), 8, '0') as hts8 from part),
f as (select substr(hts8, 1, 6) as hs6, count(*) as n, min(hts8) as only1 from l where hts8 not in (select hts8 from c) group by 1),
t as (select distinct substr(hts8, 1, 4) || '.' || substr(hts8, 5, 2) as code, substr(hts8, 1, 6) as hs6 from l)
select code, t.hs6, coalesce(n, 0) as n_candidates, case when n = 1 then only1 end as resolved_hts8 from t left join f on t.hs6 = f.hs6
""",
)
def _(v):
    lines = part_lines(v)
    other = F.when(F.col("p_size") % 15 == 0, "x").otherwise("")
    covered = v.part.select(
        F.concat(other, F.lpad((F.col("p_partkey") * 7).cast("string"), 8, "0")).alias("hts8")
    )
    truncated = lines.select(
        F.concat(F.substring("hts8", 1, 4), F.lit("."), F.substring("hts8", 5, 2)).alias("code")
    ).distinct()
    return PO.resolve_truncated(truncated, covered, lines)


@query(
    "T05_ambiguity_report",
    "select tariff_status, count(*) as n_obs, count(distinct hs6) as n_products, sum(customs_value) as customs_value from panel group by 1",
    "customs_value:1",
)
def _(v):
    return PO.ambiguity_report(panel_view(v))


