"""Queries for the entity-month panel: events, episodes, stock, exposure and survival."""

from pyspark.sql import functions as F

from quaymetrics.core import total
from quaymetrics.operators import loans as LN
from quaymetrics.operators import survival as SV
from quaymetrics.plans.projections import PMT
from quaymetrics.registry import cte, query

cte(
    "months",
    """
select m.*, case when n_rows >= 3 then 'Y' else 'N' end as modification_flag,
       datediff('month', min(period) over (partition by loan_seq_no), period) + 1 as loan_age
from loan_months m
""",
)
cte(
    "orig",
    """
select o.*, cast(f.first_period - interval 2 month as date) as approx_origination_date from originations o
join (select loan_seq_no, min(period) as first_period from loan_months group by loan_seq_no) f on o.loan_seq_no = f.loan_seq_no
""",
)
cte(
    "loan_events",
    """
select s.loan_seq_no, observation_start, last_observed_period, start_age, end_age, n_months_observed, ever_modified, last_upb,
       x.code as zero_balance_code, x.exit_at as event_date, coalesce(least(x.exit_at, last_observed_period), last_observed_period) as observation_end,
       case x.code when '01' then 'prepayment' when '03' then 'credit_event' else 'censored' end as event_type,
       case when x.code is null then 'active_at_performance_cutoff' when x.code = '15' then 'admin_removal_zb15_whole_loan_sale' end as censoring_reason,
       coalesce(n_codes, 0) > 1 as conflicting_zb_codes, coalesce(last_observed_period > x.exit_at, false) as reappeared_after_exit,
       coalesce(x.code, '') not in ('01', '03') as censored,
       greatest(datediff('month', observation_start, coalesce(least(x.exit_at, last_observed_period), last_observed_period)) + 1 - n_months_observed, 0) as n_month_gaps,
       o.orig_interest_rate, o.orig_upb, o.orig_loan_term, o.orig_ltv, o.property_state, o.loan_purpose, o.credit_score, o.approx_origination_date
from (select loan_seq_no, min(period) as observation_start, max(period) as last_observed_period, min(loan_age) as start_age, max(loan_age) as end_age,
             count(*) as n_months_observed, bool_or(modification_flag = 'Y') as ever_modified, arg_max(current_upb, period) as last_upb
      from months group by loan_seq_no) s
left join (select loan_seq_no, zero_balance_code as code, period as exit_at, n_codes from (
             select *, count(*) over (partition by loan_seq_no) as n_codes,
                    row_number() over (partition by loan_seq_no order by case zero_balance_code when '15' then 1 when '03' then 5 else 7 end, period) as rn
             from months where zero_balance_code is not null) z where rn = 1) x on s.loan_seq_no = x.loan_seq_no
join orig o on s.loan_seq_no = o.loan_seq_no
""",
)
cte(
    "monthly_rates",
    """
select p.period, r.pmms30 as market_rate, r.date as rate_obs_date
from (select cast(unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), interval 1 month)) as date) as period
      from weekly_rates) p
asof left join weekly_rates r on p.period >= r.date
""",
)
cte(
    "state_index",
    """
select cast(c_nationkey as varchar) as geography, cast(date_trunc('month', o_orderdate) as date) as period, round(avg(o_totalprice), 4) as hpi
from orders join customer on o_custkey = c_custkey group by 1, 2
""",
)
cte(
    "episode_base",
    """
select m.loan_seq_no, m.period, m.current_upb, m.loan_age, m.n_rows, e.event_type, e.event_date, e.observation_end,
       e.orig_interest_rate as note_rate, e.orig_upb, e.orig_ltv, e.orig_loan_term, e.credit_score, e.property_state, e.loan_purpose,
       e.approx_origination_date, r.market_rate, h.hpi as hpi_now, h.hpi_growth_12m, ho.hpi as hpi_at_origination,
       greatest(cast(e.orig_loan_term - m.loan_age as double), 1) as remaining_term,
       case when m.prev > 0 then m.prev when m.current_upb > 0 then m.current_upb end as upb_start_of_month,
       case when m.prev > 0 then 'prior_month_reported_upb' else 'same_month_reported_upb' end as upb_timing_source
from (select *, lag(current_upb) over (partition by loan_seq_no order by period) as prev from months) m
join loan_events e on m.loan_seq_no = e.loan_seq_no and m.period <= e.observation_end
left join monthly_rates r on m.period = r.period
left join (select *, ln(hpi) - lag(ln(hpi), 12) over (partition by geography order by period) as hpi_growth_12m from state_index) h
  on e.property_state = h.geography and m.period = h.period
left join state_index ho on e.property_state = ho.geography and ho.period = date_trunc('month', e.approx_origination_date)
""",
)
cte(
    "episodes",
    f"""
select *, market_rate - note_rate as rate_gap, greatest(market_rate - note_rate, 0) as lockin_gap, note_rate - market_rate as refi_incentive,
       pm - pn as payment_gap, (pm - pn) * (1 - power(1 + 4 / 1200.0::double, -least(84, remaining_term))) / (4 / 1200.0::double) as pv_financing_gap,
       case when g < -200 then 0 when g < -100 then 1 when g < 0 then 2 when g < 100 then 3 when g < 200 then 4 when g < 300 then 5
            when g < 400 then 6 when g is not null then 7 end as gap_bucket,
       coalesce(orig_ltv * (upb_start_of_month / orig_upb) * (hpi_at_origination / hpi_now), orig_ltv * (upb_start_of_month / orig_upb)) as est_current_ltv,
       case when hpi_now is not null and hpi_at_origination is not null then 'orig_ltv_x_amortisation_x_state_hpi'
            else 'orig_ltv_x_amortisation_only' end as ltv_source,
       year(approx_origination_date) as orig_cohort_year,
       cast(coalesce(period = event_date, false) and event_type = 'prepayment' as integer) as exit_prepayment,
       cast(coalesce(period = event_date, false) and event_type = 'credit_event' as integer) as exit_credit_event,
       cast(coalesce(period = event_date, false) and event_type <> 'censored' as integer) as exit_any,
       cast(period = observation_end and event_type = 'censored' as integer) as censored_this_month
from (select *, (market_rate - note_rate) * 100 as g, {PMT.format(b="upb_start_of_month", r="market_rate", n="remaining_term")} as pm,
             {PMT.format(b="upb_start_of_month", r="note_rate", n="remaining_term")} as pn from episode_base) b
""",
)


def locked_sql(gap, bal):
    return ",\n".join(
        f"avg(case when {gap} > {t / 100} then 1.0::double when {gap} is not null then 0 end) as locked_share_count_{t}, "
        f"sum(case when {gap} > {t / 100} then {bal} else 0 end) / nullif(sum({bal}), 0) as locked_share_upb_{t}"
        for t in LN.THRESHOLDS_BP
    )


cte(
    "stock",
    f"""
select property_state as geography, period, count(*) as n_active_loans, sum(current_upb) as total_upb, avg(note_rate) as wavg_note_rate_count,
       sum(note_rate * current_upb) / nullif(sum(current_upb), 0) as wavg_note_rate_upb, max(market_rate) as market_rate,
       {locked_sql("rate_gap", "current_upb")},
       avg(lockin_gap) as mean_lockin_gap, avg(rate_gap) as mean_rate_gap, quantile_cont(payment_gap, 0.5) as median_payment_gap,
       avg(payment_gap) as mean_payment_gap, avg(case when refi_incentive > 0.5 then 1.0::double else 0 end) as refi_incentive_share,
       avg(exit_prepayment) as prepayment_rate_monthly, avg(exit_credit_event) as credit_event_rate_monthly,
       cast(sum(exit_prepayment) as bigint) as n_prepayments, cast(sum(exit_credit_event) as bigint) as n_credit_events,
       quantile_cont(est_current_ltv, 0.5) as median_est_current_ltv, avg(credit_score) as mean_credit_score,
       avg(orig_cohort_year) as mean_orig_cohort_year, avg(case when loan_purpose = 'P' then 1.0::double else 0 end) as share_purchase_loans,
       quantile_cont(note_rate, 0.1) as note_rate_p10, quantile_cont(note_rate, 0.25) as note_rate_p25, quantile_cont(note_rate, 0.5) as note_rate_p50,
       quantile_cont(note_rate, 0.75) as note_rate_p75, quantile_cont(note_rate, 0.9) as note_rate_p90
from episodes where property_state is not null and market_rate is not null group by property_state, period
""",
)
LOCKED = " ".join(f"locked_share_count_{t} locked_share_upb_{t}" for t in LN.THRESHOLDS_BP)
STOCK_DIGITS = (
    f"total_upb:2 wavg_note_rate_count wavg_note_rate_upb market_rate {LOCKED} mean_lockin_gap mean_rate_gap median_payment_gap:4 "
    "mean_payment_gap:4 refi_incentive_share prepayment_rate_monthly credit_event_rate_monthly median_est_current_ltv:5 "
    "mean_credit_score:5 mean_orig_cohort_year:5 share_purchase_loans note_rate_p10 note_rate_p25 note_rate_p50 note_rate_p75 note_rate_p90"
)

EVENT_COLUMNS = (
    "loan_seq_no, observation_start, last_observed_period, start_age, end_age, n_months_observed, ever_modified, last_upb, "
    "zero_balance_code, event_date, observation_end, event_type, censoring_reason, conflicting_zb_codes, reappeared_after_exit, "
    "censored, n_month_gaps, orig_upb, property_state"
)


@query("A12_entity_events", f"select {EVENT_COLUMNS} from loan_events", "last_upb:2 orig_upb:2")
def _(v):
    return LN.events_view(v).select(*EVENT_COLUMNS.split(", "))


@query(
    "A12_effective_dates",
    """
with m as (select *, case when zero_balance_code is not null and loan_seq_no % 3 = 0 then cast(period - interval 2 month as date) end as effective, cast(n_rows % 5 as varchar) as status from months),
x as (select loan_seq_no, coalesce(effective, period) as exit_at from (
  select *, row_number() over (partition by loan_seq_no order by case zero_balance_code when '15' then 1 when '03' then 5 else 7 end, period) as rn from m where zero_balance_code is not null) z where rn = 1),
s as (select loan_seq_no, max(period) as last_observed_period, bool_or(status in ('1', '2', '3')) as ever_30d_plus from m group by loan_seq_no)
select s.loan_seq_no, exit_at as event_date, coalesce(least(exit_at, last_observed_period), last_observed_period) as observation_end,
  coalesce(last_observed_period > exit_at, false) as reappeared_after_exit, ever_30d_plus, o.approx_origination_date as entry_date
from s left join x on s.loan_seq_no = x.loan_seq_no join orig o on s.loan_seq_no = o.loan_seq_no
""",
)
def _(v):
    exits = F.col("zero_balance_code").isNotNull() & (F.col("loan_seq_no") % 3 == 0)
    months = LN.months_view(v).withColumns(
        {
            "zero_balance_effective_date": F.when(exits, F.add_months("period", -2)),
            "delinquency_status": (F.col("n_rows") % 5).cast("string"),
        }
    )
    orig = LN.originations_view(v).withColumn("first_payment_date", F.col("approx_origination_date"))
    return LN.entity_events(months, orig).select(
        "loan_seq_no", "event_date", "observation_end", "reappeared_after_exit", "ever_30d_plus", "entry_date"
    )


@query(
    "A13_event_summary",
    """
select event_type, count(*) as n_loans, sum(orig_upb) as orig_upb, count(*) filter (where start_age > 1) as n_left_truncated,
       count(*) filter (where n_month_gaps > 0) as n_with_month_gaps, count(*) filter (where conflicting_zb_codes) as n_conflicting_zb,
       count(*) filter (where reappeared_after_exit) as n_reappeared_after_exit, min(observation_start) as observation_start_min,
       max(observation_end) as observation_end_max
from loan_events group by event_type
""",
    "orig_upb:2",
)
def _(v):
    return LN.event_summary(LN.events_view(v))


@query(
    "A13_maturity_like",
    """
select count(*) filter (where event_type = 'prepayment') as n_prepayments,
       count(*) filter (where event_type = 'prepayment' and datediff('month', event_date, last_observed_period + interval 1 month) <= 3) as n_maturity_like
from loan_events
""",
)
def _(v):
    return LN.maturity_like(LN.events_view(v), F.add_months("last_observed_period", 1))


@query("A14_active_stock", "select * from stock", STOCK_DIGITS)
def _(v):
    return LN.stock_view(v)


@query(
    "A15_cohort_mix",
    """
select property_state as geography, period, orig_cohort_year, count(*) as n, sum(current_upb) as upb
from episodes where property_state is not null group by 1, 2, 3
""",
    "upb:2",
)
def _(v):
    return LN.cohort_mix(LN.episodes_view(v))


@query(
    "A16_stock_coverage",
    """
with p as (select period, cast(sum(n_active_loans) as bigint) as n, sum(total_upb) as upb, count(distinct geography) as g from stock group by period),
f as (select arg_min(n, period) as n0, arg_max(n, period) as n1, min(period) as p0, max(period) as p1, arg_min(upb, period) as u0,
             arg_max(upb, period) as u1, arg_max(g, period) as g1, max(n) as np from p)
select p0 as first_period, p1 as last_period, n0 as n_active_first, n1 as n_active_last,
       (select min(period) from p where n = np) as peak_period, np as n_active_peak,
       100.0::double * (1 - n1 / np::double) as attrition_from_peak_pct, 100.0::double * (n1 / n0::double - 1) as net_change_first_to_last_pct,
       u0 as upb_first, u1 as upb_last, g1 as n_geographies
from f
""",
    "attrition_from_peak_pct:2 net_change_first_to_last_pct:2 upb_first:2 upb_last:2",
)
def _(v):
    return LN.stock_coverage(LN.stock_view(v))


PRE = "1997-06-01"


@query(
    "A17_predetermined_exposure",
    f"""
with post as (select avg(market_rate) as r from monthly_rates where period >= date '1999-01-01'),
b as (select e.*, r, r - note_rate as cf, {PMT.format(b="upb_start_of_month", r="r", n="remaining_term")}
             - {PMT.format(b="upb_start_of_month", r="note_rate", n="remaining_term")} as cp
      from episodes e, post where period = date '{PRE}'),
h as (select property_state, sum(n * n) / (sum(n) * sum(n)) as hhi from (
        select property_state, round(note_rate * 4) / 4 as c, cast(count(*) as double) as n from b group by 1, 2) x group by 1)
select b.property_state as geography, count(*) as n_active_loans, sum(upb_start_of_month) as total_upb, avg(note_rate) as wavg_note_rate_count,
       sum(note_rate * upb_start_of_month) / sum(upb_start_of_month) as wavg_note_rate_upb, {locked_sql("cf", "upb_start_of_month")},
       {", ".join(f"avg(case when note_rate < r - {t / 100} then 1.0::double else 0 end) as coupon_share_below_{t}" for t in LN.THRESHOLDS_BP)},
       avg(cf) as mean_rate_gap, avg(greatest(cf, 0)) as mean_lockin_gap, avg(cp) as mean_payment_gap, max(hhi) as coupon_share_hhi
from b join h on b.property_state = h.property_state group by b.property_state
""",
    f"total_upb:2 wavg_note_rate_count wavg_note_rate_upb {LOCKED} coupon_share_below_100 coupon_share_below_200 coupon_share_below_300 "
    "coupon_share_below_400 mean_rate_gap mean_lockin_gap mean_payment_gap:4 coupon_share_hhi",
)
def _(v):
    rates = LN.monthly_rate(v.weekly_rates, "pmms30").where("period >= '1999-01-01'")
    return LN.predetermined_exposure(LN.episodes_view(v), PRE, total(rates, F.avg("market_rate")))


@query(
    "A18_geography_exposure",
    f"""
with b as (select *, 6.0::double as m, 6.0::double - orig_interest_rate as gap, 360.0::double as n,
                  {PMT.format(b="orig_upb", r="6.0::double", n="360.0::double")} - {PMT.format(b="orig_upb", r="orig_interest_rate", n="360.0::double")} as pg
           from originations)
select property_state, count(*) as n_loans, sum(orig_upb) as total_upb, avg(orig_interest_rate) as wavg_note_rate_count,
       sum(orig_interest_rate * orig_upb) / sum(orig_upb) as wavg_note_rate_upb, {locked_sql("gap", "orig_upb")},
       avg(greatest(gap, 0)) as mean_lockin_gap, avg(pg) as mean_payment_gap, avg(case when -gap > 0.5 then 1.0::double else 0 end) as refi_incentive_share
from b group by property_state
""",
    f"total_upb:2 wavg_note_rate_count wavg_note_rate_upb {LOCKED} mean_lockin_gap mean_payment_gap:4 refi_incentive_share",
)
def _(v):
    df = v.originations.withColumn("market_rate", F.lit(6.0))
    return LN.geography_exposure(
        df, ["property_state"], "market_rate", "orig_interest_rate", "orig_upb", "orig_loan_term"
    )


@query(
    "A19_exposure_distribution",
    """
with g as (select geography, arg_min(wavg_note_rate_upb, period) as e, avg(n_active_loans) as a, avg(median_est_current_ltv) as l from stock group by geography)
select count(*) as n_geographies, avg(e) as mean, stddev_samp(e) as sd, min(e) as min, quantile_cont(e, 0.25) as p25, quantile_cont(e, 0.5) as median,
       quantile_cont(e, 0.75) as p75, max(e) as max, corr(e, a) as corr_n_active_loans, corr(e, l) as corr_median_est_current_ltv
from g
""",
    "mean sd min p25 median p75 max corr_n_active_loans corr_median_est_current_ltv",
)
def _(v):
    return LN.exposure_distribution(
        LN.stock_view(v), "wavg_note_rate_upb", ["n_active_loans", "median_est_current_ltv"]
    )


@query(
    "A19_extremes",
    """
with g as (select geography, arg_min(wavg_note_rate_upb, period) as exposure from stock group by geography)
select geography, exposure, 'top' as "end" from (select * from g order by exposure desc, geography limit 5) a
union all select geography, exposure, 'bottom' from (select * from g order by exposure, geography limit 5) b
""",
    "exposure",
)
def _(v):
    return LN.extremes(LN.stock_view(v), "wavg_note_rate_upb")


COEFS = {"intercept": -4.0, "rate_gap": -0.35, "credit_score": 0.002, "est_current_ltv": -0.004}


@query(
    "A42_score_scenario",
    """
with m as (select avg(credit_score) as cs, avg(est_current_ltv) as lt from episodes),
s as (select property_state, upb_start_of_month as b, -4.0::double + 0.002::double * coalesce(credit_score, cs) - 0.004::double * coalesce(est_current_ltv, lt) as base,
             coalesce(rate_gap, 0) as g from episodes, m),
h as (select property_state, b, 1 / (1 + exp(-(base - 0.35::double * g))) as h0, 1 / (1 + exp(-(base - 0.35::double * (g - 1.0::double)))) as h1 from s)
select property_state as geography, count(*) as n_loans, sum(h0) as baseline_expected_exits, sum(h1) as scenario_expected_exits,
       sum(h1 - h0) as additional_expected_exits, sum((h1 - h0) * b) as additional_prepaid_upb, sum(h1 - h0) / sum(h0) as pct_change_in_exits
from h group by property_state
""",
    "baseline_expected_exits scenario_expected_exits additional_expected_exits additional_prepaid_upb:2 pct_change_in_exits",
)
def _(v):
    return LN.score_scenario(
        LN.episodes_view(v), COEFS, -1.0, ["credit_score", "est_current_ltv"]
    )


# --- episodes and survival --------------------------------------------------------

EPISODE_COLUMNS = (
    "loan_seq_no, period, current_upb, loan_age, note_rate, market_rate, remaining_term, upb_start_of_month, upb_timing_source, "
    "rate_gap, lockin_gap, refi_incentive, payment_gap, pv_financing_gap, gap_bucket, est_current_ltv, ltv_source, hpi_growth_12m, "
    "orig_cohort_year, property_state, exit_prepayment, exit_credit_event, exit_any, censored_this_month"
)
EPISODE_DIGITS = (
    "current_upb:2 note_rate market_rate remaining_term upb_start_of_month:2 rate_gap lockin_gap refi_incentive payment_gap:4 "
    "pv_financing_gap:3 est_current_ltv:5 hpi_growth_12m"
)


@query("L01_episodes", f"select {EPISODE_COLUMNS} from episodes", EPISODE_DIGITS)
def _(v):
    return LN.build_episodes(v).select(*EPISODE_COLUMNS.split(", "))


cte(
    "discrete",
    """
select *, case when loan_age < 12 then 'age_0_12' when loan_age < 24 then 'age_12_24' when loan_age < 48 then 'age_24_48' else 'age_48_120' end as age_bin,
       ln(orig_upb) as log_orig_upb, year(period) as calendar_year, year(period) * 12 + month(period) as period_index,
       case when exit_any = 1 then 1.0::double else 4.0::double end as sampling_weight
from episodes
where market_rate is not null and rate_gap is not null and period < date '1999-01-01'
  and (exit_any = 1 or ('0x' || substr(md5(cast(loan_seq_no as varchar) || 'risk'), 1, 8))::bigint % 1000000 < 250000)
""",
)


cte(
    "discrete_all",
    """
select *, case when loan_age < 12 then 'age_0_12' when loan_age < 24 then 'age_12_24' when loan_age < 48 then 'age_24_48' else 'age_48_120' end as age_bin
from episodes where market_rate is not null and rate_gap is not null and period < date '1999-01-01'
""",
)


@query(
    "L02_discrete_time",
    "select loan_seq_no, period, age_bin, log_orig_upb, calendar_year, period_index, sampling_weight, exit_any, rate_gap from discrete",
    "log_orig_upb rate_gap",
)
def _(v):
    out = SV.discrete_time(LN.episodes_view(v), "1999-01-01", fraction=0.25, salt="risk")
    return out.select(
        "loan_seq_no",
        "period",
        "age_bin",
        "log_orig_upb",
        "calendar_year",
        "period_index",
        "sampling_weight",
        "exit_any",
        "rate_gap",
    )


cte(
    "loan_level",
    """
select loan_seq_no, min(loan_age) as entry_age, max(loan_age) as exit_age,
       case when max(exit_prepayment) = 1 then 1 when max(exit_credit_event) = 1 then 2 else 0 end as event_code,
       arg_min(coalesce(rate_gap, -99), period) as rate_gap_at_entry, arg_max(coalesce(rate_gap, -99), period) as rate_gap_at_exit, avg(lockin_gap) as mean_lockin_gap,
       arg_min(note_rate, period) as note_rate, arg_min(property_state, period) as property_state,
       arg_min(loan_purpose, period) as loan_purpose, min(period) as first_period,
       max(period) as last_period, count(*) as n_months_observed, max(loan_age) - min(loan_age) + 1 as months_at_risk, min(loan_age) > 1 as left_truncated
from episodes group by loan_seq_no
""",
)
LEVEL_COLUMNS = (
    "loan_seq_no, entry_age, exit_age, event_code, rate_gap_at_entry, rate_gap_at_exit, mean_lockin_gap, note_rate, "
    "property_state, loan_purpose, first_period, last_period, n_months_observed, months_at_risk, left_truncated"
)


@query(
    "L03_loan_level",
    f"select {LEVEL_COLUMNS} from loan_level",
    "rate_gap_at_entry rate_gap_at_exit mean_lockin_gap note_rate",
)
def _(v):
    out = SV.loan_level(LN.episodes_view(v)).select(*LEVEL_COLUMNS.split(", "))
    known = {c: F.coalesce(F.col(c), F.lit(-99.0)) for c in ("rate_gap_at_entry", "rate_gap_at_exit")}
    return out.withColumns(known)


# Loans enter one age before their first observed month, so that month counts as risk time.
KM = """
with x as (select {g} as grp, exit_age - months_at_risk + (loan_seq_no % 3) as entry, exit_age as ex, event_code from loan_level),
a as (select grp, t, sum(e) as e, sum(x) as x, sum(d1) as d1, sum(d2) as d2 from (
        select grp, entry as t, 1 as e, 0 as x, 0 as d1, 0 as d2 from x
        union all select grp, ex, 0, 1, cast(event_code = 1 as integer), cast(event_code = 2 as integer) from x) u group by grp, t),
r as (select grp, t, d1, d2, coalesce(sum(e) over w, 0) - coalesce(sum(x) over w, 0) as n from a
      window w as (partition by grp order by t rows between unbounded preceding and 1 preceding))
"""


@query(
    "L04_kaplan_meier",
    KM.format(g="'all'")
    + """
select grp, cast(t as bigint) as age, cast(n as bigint) as n_at_risk, cast(d1 as bigint) as n_events,
       product(1 - d1 / n::double) over (partition by grp order by t) as survival
from r where d1 > 0 and n > 0
""",
    "survival",
)
def _(v):
    loans = _spans(v).withColumn("grp", F.lit("all"))
    return SV.kaplan_meier(loans, ["grp"], "entry", "exit_age", "event_code", 1)


@query(
    "L04_kaplan_meier_by_group",
    KM.format(g="loan_purpose")
    + """
select grp, cast(t as bigint) as age, cast(n as bigint) as n_at_risk, cast(d1 as bigint) as n_events,
       product(1 - d1 / n::double) over (partition by grp order by t) as survival
from r where d1 > 0 and n > 0
""",
    "survival",
)
def _(v):
    loans = _spans(v).withColumnRenamed("loan_purpose", "grp")
    return SV.kaplan_meier(loans, ["grp"], "entry", "exit_age", "event_code", 1)


def _spans(v):
    """Risk starts up to two ages around the first observed month, to exercise truncation."""
    level = SV.loan_level(LN.episodes_view(v))
    return level.withColumn(
        "entry", F.col("exit_age") - F.col("months_at_risk") + F.col("loan_seq_no") % 3
    )


@query(
    "L05_cumulative_incidence",
    KM.format(g="'all'")
    + """
, s as (select *, product(1 - (d1 + d2) / n::double) over (partition by grp order by t) as after from r where d1 + d2 > 0 and n > 0),
p as (select *, coalesce(lag(after) over (partition by grp order by t), 1) as before from s)
select grp, cast(t as bigint) as age, cast(n as bigint) as n_at_risk, cast(d1 + d2 as bigint) as n_events_all,
       sum(before * d1 / n) over (partition by grp order by t) as cif_cause_1, sum(before * d2 / n) over (partition by grp order by t) as cif_cause_2
from p
""",
    "cif_cause_1 cif_cause_2",
)
def _(v):
    loans = _spans(v).withColumn("grp", F.lit("all"))
    return SV.cumulative_incidence(loans, ["grp"], "entry", "exit_age", "event_code", (1, 2))


@query(
    "L06_hazard_profile",
    """
select 'age_bin' as profile, age_bin as bin, count(*) as n_at_risk, cast(sum(exit_prepayment) as bigint) as n_events, avg(exit_prepayment) as hazard,
       avg(loan_age) as mean_age, avg(rate_gap) as mean_rate_gap from discrete_all group by age_bin
union all
select 'gap_bucket', cast(gap_bucket as varchar), count(*), cast(sum(exit_prepayment) as bigint), avg(exit_prepayment), avg(loan_age), avg(rate_gap)
from discrete_all group by gap_bucket
""",
    "hazard mean_age mean_rate_gap",
)
def _(v):
    data = SV.discrete_time(LN.episodes_view(v), "1999-01-01", fraction=1.0, salt="risk")
    return SV.hazard_profile(data, ["age_bin", "gap_bucket"], "exit_prepayment")


COVARIATES = ["rate_gap", "log_orig_upb", "est_current_ltv"]


# Dummies alone saturate the model: log odds of each level, errors from sums within loans.
@query(
    "L07_hazard_glm_saturated",
    """
with u as (select loan_seq_no as c, 'm' || (loan_age % 3) as age_bin, exit_any::double as y from discrete_all),
a as (select age_bin, avg(y) as p, count(*) * avg(y) * (1 - avg(y)) as w, ln(avg(y) / (1 - avg(y))) as l from u group by 1),
b as (select * from a where age_bin = (select min(age_bin) from a)),
i as (select c, age_bin, sum(y - p) as s from u join a using (age_bin) group by 1, 2),
n as (select count(*) as n_obs, count(distinct c) as n_clusters, cast(sum(y) as bigint) as n_events, (select count(*) from a) as k from u),
j as (select a.age_bin, a.age_bin = b.age_bin as base, a.l, b.l as l0, coalesce(i.s, 0) / a.w as f, coalesce(z.s, 0) / b.w as f0
      from (select distinct c from u) cl cross join a cross join b left join i on i.c = cl.c and i.age_bin = a.age_bin left join i z on z.c = cl.c and z.age_bin = b.age_bin),
t as (select case when base then 'intercept' else 'is_' || age_bin end as term, case when base then l0 else l - l0 end as estimate, sum(power(case when base then f0 else f - f0 end, 2)) as v from j group by 1, 2)
select term, estimate, sqrt(v * (n_clusters / (n_clusters - 1)::double) * (n_obs - 1) / (n_obs - k)::double) as std_error, exp(estimate) as hazard_ratio, n_obs, n_events, n_clusters, true as converged from t, n
""",
    "estimate:5 std_error:5 hazard_ratio:5",
)
def _(v):
    data = SV.discrete_time(LN.episodes_view(v), "1999-01-01", salt="risk")
    thirds = F.concat(F.lit("m"), (F.col("loan_age") % 3).cast("string"))  # events in each
    out = SV.hazard_glm(data.withColumn("age_bin", thirds), "exit_any", [], "loan_seq_no")
    return out.select(
        "term", "estimate", "std_error", "hazard_ratio", "n_obs", "n_events", "n_clusters", "converged"
    )


@query("L07_hazard_glm")
def _(v):
    data = SV.discrete_time(LN.episodes_view(v), "2001-01-01", fraction=0.5, salt="risk")
    return SV.hazard_glm(data, "exit_prepayment", COVARIATES, "loan_seq_no", link="logit")


@query("L07_hazard_glm_cloglog")
def _(v):
    data = SV.discrete_time(LN.episodes_view(v), "2001-01-01", fraction=0.5, salt="risk")
    return SV.hazard_glm(data, "exit_prepayment", COVARIATES, "loan_seq_no", link="cloglog")


@query("L08_gbt_benchmark")
def _(v):
    eps = LN.episodes_view(v)
    train = SV.discrete_time(eps, "1999-01-01")
    test = SV.discrete_time(eps, "1999-01-01", out_of_time=True)
    return SV.gbt_benchmark(train, test, "exit_prepayment", COVARIATES)


@query(
    "L09_relabel_administrative",
    """
select e.loan_seq_no, e.period, greatest(e.exit_prepayment, cast(coalesce(e.period = l.event_date, false) and coalesce(l.zero_balance_code = '15', false) as integer)) as exit_prepayment
from episodes e join loan_events l on e.loan_seq_no = l.loan_seq_no
""",
)
def _(v):
    eps, events = LN.episodes_view(v), LN.events_view(v)
    return LN.relabel_administrative(eps, events).select("loan_seq_no", "period", "exit_prepayment")


@query(
    "L09_month_end_alignment",
    """
with alt as (select p.period, r.pmms30 as market_rate from (select distinct period from monthly_rates) p
             asof left join weekly_rates r on last_day(p.period) >= r.date)
select e.loan_seq_no, e.period, a.market_rate - e.note_rate as rate_gap
from episodes e join alt a on e.period = a.period where a.market_rate is not null
""",
    "rate_gap",
)
def _(v):
    alt = LN.monthly_rate(v.weekly_rates, "pmms30", "month_end")
    return LN.realign_rate(LN.episodes_view(v), alt).select("loan_seq_no", "period", "rate_gap")


@query(
    "L09_fresh_term",
    f"""
select avg(payment_gap) as mean_payment_gap_remaining_term, avg(f) as mean_payment_gap_fresh_term, corr(payment_gap, f) as correlation,
       count(payment_gap) as n_known
from (select payment_gap, {PMT.format(b="upb_start_of_month", r="market_rate", n="360")} - pn as f from episodes) x
""",
    "mean_payment_gap_remaining_term:4 mean_payment_gap_fresh_term:4 correlation",
)
def _(v):
    return LN.fresh_term_summary(LN.episodes_view(v))


GROUPS = {
    "loan_age_group": "case when loan_age < 24 then '<24m' when loan_age < 48 then '24-47m' else '48m+' end",
    "credit_score_group": "case when credit_score < 700 then '<700' when credit_score < 760 then '700-759' else '760+' end",
    "balance_group": "case when orig_upb < 200000 then '<200k' when orig_upb < 400000 then '200-400k' else '400k+' end",
    "loan_purpose": "loan_purpose",
}


@query(
    "L10_heterogeneity",
    "\nunion all\n".join(
        f"select '{n}' as grouping_name, {g} as group_value, count(*) as n_loan_months, count(distinct loan_seq_no) as n_loans, "
        "cast(sum(exit_prepayment) as bigint) as n_prepayments, avg(exit_prepayment) as monthly_prepay_hazard, avg(rate_gap) as mean_rate_gap, "
        f"avg(payment_gap) as mean_payment_gap from episodes group by {g}"
        for n, g in GROUPS.items()
    ),
    "monthly_prepay_hazard mean_rate_gap mean_payment_gap:4",
)
def _(v):
    groups = {n: F.expr(e) for n, e in GROUPS.items()}
    return SV.hazard_by(LN.episodes_view(v), groups)


# --- checks -----------------------------------------------------------------------


@query(
    "Q04_panel_checks",
    """
with s as (select *, datediff('month', lag(period) over (partition by loan_seq_no order by period), period) as step from months),
f as (select count(*) as n_rows_, count(*) filter (where step = 0) as a, 0 as b, count(*) filter (where step > 1) as c, count(*) filter (where current_upb < 0) as d,
             count(*) filter (where zero_balance_code is not null and zero_balance_code not in ('01', '03')) as e from s),
g as (select count(*) as loans, count(*) filter (where n > 1) as a, count(*) filter (where top <= 0) as b from (
        select loan_seq_no, count(zero_balance_code) as n, max(current_upb) as top from months group by loan_seq_no) l),
t as (select 'duplicate_keys' as "check", f.a as n, f.a / n_rows_::double as prevalence, 0.0::double as tolerated from f
      union all select 'age_regressions', f.b, f.b / n_rows_::double, 0.001 from f
      union all select 'month_gaps', f.c, f.c / n_rows_::double, 0.05 from f
      union all select 'negative_balances', f.d, f.d / n_rows_::double, 0 from f
      union all select 'unknown_codes', f.e, f.e / n_rows_::double, 0 from f
      union all select 'loans_with_several_codes', g.a, g.a / loans::double, 0.01 from g
      union all select 'loans_never_positive', g.b, g.b / loans::double, 0.01 from g)
select "check", n, prevalence, tolerated, case when n = 0 then 'OK' when prevalence <= tolerated then 'SOFT' else 'HARD' end as severity from t
""",
    "prevalence tolerated",
)
def _(v):
    return LN.panel_checks(LN.months_view(v), ["01", "03"])


@query(
    "Q05_event_checks",
    """
with f as (select count(*) - count(distinct loan_seq_no) as a, count(*) filter (where observation_end < observation_start) as b,
                  count(*) filter (where event_date < observation_start) as c, count(*) filter (where event_type not in ('prepayment', 'credit_event', 'censored')) as d,
                  count(*) filter (where zero_balance_code = '15' and not censored) as e, count(*) filter (where conflicting_zb_codes) as g, count(*) filter (where reappeared_after_exit) as h,
                  count(*) filter (where start_age > 1) as i, count(*) filter (where n_month_gaps > 0) as j from loan_events),
t as (select 'duplicate_loans' as "check", 'HARD' as severity, a as n from f union all select 'bad_order', 'HARD', b from f
      union all select 'early_exit', 'HARD', c from f union all select 'unknown_event_type', 'HARD', d from f
      union all select 'administrative_not_censored', 'HARD', e from f union all select 'conflicting_codes', 'SOFT', g from f
      union all select 'reappeared', 'SOFT', h from f union all select 'left_truncated', 'SOFT', i from f union all select 'with_gaps', 'SOFT', j from f)
select *, n = 0 as passed from t
""",
)
def _(v):
    return LN.event_checks(LN.events_view(v))


@query(
    "Q05_episode_checks",
    """
with f as (select count(*) filter (where market_rate is null) as a, count(*) filter (where exit_prepayment = 1 and exit_credit_event = 1) as b,
                  count(*) filter (where abs(rate_gap - (market_rate - note_rate)) > 1e-9) as c,
                  count(*) filter (where upb_start_of_month > 0 and abs(rate_gap) > 0.01 and sign(payment_gap) <> sign(rate_gap)) as d,
                  count(*) filter (where exit_any = 1 and upb_start_of_month <= 0) as e, count(*) filter (where remaining_term <= 0) as g from episodes),
m as (select count(*) filter (where k > 1) as k from (select loan_seq_no, sum(exit_any) as k from episodes group by 1) x),
t as (select 'several_exits' as "check", 'HARD' as severity, k as n from m union all select 'two_exit_kinds', 'HARD', b from f
      union all select 'gap_identity', 'HARD', c from f union all select 'gap_signs', 'HARD', d from f
      union all select 'exit_without_balance', 'HARD', e from f union all select 'nonpositive_term', 'HARD', g from f
      union all select 'no_market_rate', 'SOFT', a from f)
select *, n = 0 as passed from t
""",
)
def _(v):
    return LN.episode_checks(LN.episodes_view(v))
