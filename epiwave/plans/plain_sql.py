"""Plain-SQL statements of the registered queries, for an independent engine to check.

Common table expressions shared by many queries come first; ``sql(body)`` puts
the ones a query needs in front of it.
"""

from __future__ import annotations

import re

WEEK = "PARTITION BY country ORDER BY week"
DAY = "PARTITION BY country ORDER BY date"

CTES = {
    "rows_a": """
        SELECT n_name AS country, CAST(o_orderdate AS DATE) AS date, 1 AS cases,
               CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS deaths
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "daily_a": """
        SELECT country, date, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(deaths) AS BIGINT) AS deaths
        FROM rows_a GROUP BY country, date""",
    "rep_a": f"""
        SELECT country, date,
               CAST(sum(cases) OVER ({DAY} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_cases,
               CAST(sum(deaths) OVER ({DAY} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_deaths
        FROM daily_a""",
    "inc_a": f"""
        SELECT *, greatest(coalesce(cum_cases - lag(cum_cases) OVER ({DAY}), 0), 0) AS new_cases,
               coalesce(cum_deaths - lag(cum_deaths) OVER ({DAY}), 0) AS new_deaths,
               CASE WHEN cum_cases > 0 THEN round_even(cum_deaths / cum_cases * 100.0 * 100.0, 0) / 100.0 ELSE 0.0 END AS cfr
        FROM rep_a""",
    "wk_a": """
        SELECT country, CAST(date_trunc('week', date) AS DATE) AS week,
               max(cum_cases) AS cum_cases, max(cum_deaths) AS cum_deaths,
               CAST(sum(new_cases) AS BIGINT) AS new_cases, CAST(sum(new_deaths) AS BIGINT) AS new_deaths,
               arg_max(cfr, date) FILTER (WHERE cfr IS NOT NULL) AS cfr
        FROM inc_a GROUP BY country, CAST(date_trunc('week', date) AS DATE)""",
    "ph_a": f"""
        SELECT * EXCLUDE (past, future), CASE
                 WHEN future IS NULL OR (past < 2 AND future < 2) THEN 'Contained' WHEN past = 0 THEN 'Growing'
                 WHEN future > past * 1.25 THEN 'Growing' WHEN future < past * 0.75 THEN 'Declining'
                 ELSE 'Stable/Peak' END AS phase
        FROM (SELECT *, avg(new_cases) OVER ({WEEK} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS past,
                     avg(new_cases) OVER ({WEEK} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS future FROM wk_a)""",
    "feat_a": f"""
        SELECT *, CAST(dense_rank() OVER (ORDER BY country) - 1 AS INTEGER) AS country_enc,
               CAST(week - min(week) OVER (PARTITION BY country) AS INTEGER) AS days_into_epidemic,
               lag(new_cases, 1) OVER w AS new_cases_lag1, lag(new_cases, 2) OVER w AS new_cases_lag2,
               lag(new_cases, 3) OVER w AS new_cases_lag3, lag(new_deaths, 1) OVER w AS new_deaths_lag1,
               lag(new_deaths, 2) OVER w AS new_deaths_lag2, lag(new_deaths, 3) OVER w AS new_deaths_lag3,
               avg(new_cases) OVER ({WEEK} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS cases_3w_avg,
               avg(new_deaths) OVER ({WEEK} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS deaths_3w_avg,
               CASE WHEN lag(cum_cases, 2) OVER w <> 0 THEN
                 greatest(least(lag(new_cases, 1) OVER w / lag(cum_cases, 2) OVER w, 5.0), -5.0) END AS case_growth_rate,
               CASE WHEN lag(cum_deaths, 2) OVER w <> 0 THEN
                 greatest(least(lag(new_deaths, 1) OVER w / lag(cum_deaths, 2) OVER w, 5.0), -5.0) END AS death_growth_rate,
               lag(cum_cases, 1) OVER w AS cum_cases_lag1, lag(cum_deaths, 1) OVER w AS cum_deaths_lag1
        FROM ph_a WINDOW w AS ({WEEK})""",
    "mat_a": """
        SELECT country, week, phase, new_cases, CASE WHEN week < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS split,
               CAST(country_enc AS DOUBLE) AS country_enc, CAST(days_into_epidemic AS DOUBLE) AS days_into_epidemic,
               CAST(new_cases_lag1 AS DOUBLE) AS new_cases_lag1, CAST(new_cases_lag2 AS DOUBLE) AS new_cases_lag2,
               CAST(new_cases_lag3 AS DOUBLE) AS new_cases_lag3, CAST(new_deaths_lag1 AS DOUBLE) AS new_deaths_lag1,
               CAST(new_deaths_lag2 AS DOUBLE) AS new_deaths_lag2, CAST(new_deaths_lag3 AS DOUBLE) AS new_deaths_lag3,
               cases_3w_avg, deaths_3w_avg, case_growth_rate, death_growth_rate,
               CAST(cum_cases_lag1 AS DOUBLE) AS cum_cases_lag1, CAST(cum_deaths_lag1 AS DOUBLE) AS cum_deaths_lag1
        FROM feat_a
        WHERE new_cases_lag3 IS NOT NULL AND new_deaths_lag3 IS NOT NULL
          AND case_growth_rate IS NOT NULL AND death_growth_rate IS NOT NULL""",
    "pop_a": """
        SELECT n_name AS country, CAST(count(*) * 1000 AS DOUBLE) AS population
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "seed_a": """
        SELECT *, greatest(y0 * 2.0, 1.0) AS e0, greatest(y0, 1.0) AS i0
        FROM (SELECT country, min(week) AS t0, CAST(arg_min(cum_cases, week) AS DOUBLE) AS y0,
                     CAST(max(week) - min(week) AS INTEGER) AS t_max,
                     CAST(max(cum_deaths) AS DOUBLE) / CAST(max(cum_cases) AS DOUBLE) AS share
              FROM wk_a GROUP BY country)""",
    # Curves of every country: rates follow from its share of deaths.
    "par_a": """
        SELECT country, CAST(t0 + 28 AS DATE) AS t0, CAST(t0 + (t_max - 56) AS DATE) AS t_end, share, population,
               CASE WHEN share < 1.0e0 / 3.0e0 THEN 0.3e0 ELSE 0.1e0 + 0.1e0 * share END AS beta, 0.05e0 + 0.05e0 * share AS gamma
        FROM seed_a JOIN pop_a USING (country)""",
    # A curve is known only where the population is at least the average.
    "fit_a": "SELECT * FROM par_a WHERE population >= (SELECT avg(population) FROM pop_a)",
    "curve_a": """
        SELECT s.country, CAST(s.d - s.t0 AS INTEGER) AS day, CAST(coalesce(c.cases, 0) AS DOUBLE) AS i
        FROM (SELECT country, t0, CAST(unnest(generate_series(t0, t_end, INTERVAL 1 DAY)) AS DATE) AS d FROM par_a) s
        LEFT JOIN daily_a c ON c.country = s.country AND c.date = s.d""",
    "total_a": "SELECT country, day, sum(i) OVER (PARTITION BY country ORDER BY day) AS total FROM curve_a",
    "cph_a": """
        SELECT m.*, CASE
                 WHEN f.country IS NULL OR m.week < f.t0 THEN 'Contained'
                 WHEN now.i IS NULL OR CASE WHEN m.week - f.t0 + 7 > z.d1 THEN z.last ELSE soon.i END IS NULL THEN NULL
                 WHEN now.i < f.population / 100000 THEN 'Contained'
                 WHEN CASE WHEN m.week - f.t0 + 7 > z.d1 THEN z.last ELSE soon.i END / greatest(now.i, 0.000001e0) > 1.25 THEN 'Growing'
                 WHEN CASE WHEN m.week - f.t0 + 7 > z.d1 THEN z.last ELSE soon.i END / greatest(now.i, 0.000001e0) < 0.75 THEN 'Declining'
                 ELSE 'Stable/Peak' END AS curve_phase
        FROM mat_a m LEFT JOIN fit_a f ON m.country = f.country
        LEFT JOIN (SELECT country, max(day) AS d1, arg_max(i, day) AS last FROM curve_a GROUP BY country) z ON z.country = m.country
        LEFT JOIN curve_a now ON now.country = m.country AND now.day = least(CAST(m.week - f.t0 AS INTEGER), z.d1)
        LEFT JOIN curve_a soon ON soon.country = m.country AND soon.day = CAST(m.week - f.t0 AS INTEGER) + 7""",
    "naive_a": f"""
        SELECT *, lag(phase) OVER ({WEEK}) AS last_phase,
               (SELECT phase FROM mat_a WHERE split = 'train' GROUP BY phase ORDER BY count(*) DESC, phase LIMIT 1) AS top_phase
        FROM cph_a""",
    "hour_b": """
        SELECT event_type AS country, date_trunc('hour', ts) AS date, count(*) AS cases,
               count(*) FILTER (WHERE value >= 20) AS deaths, count(*) FILTER (WHERE value < 20) AS probable,
               count(*) FILTER (WHERE value < 5) AS suspected, count(*) FILTER (WHERE value >= 50) AS treated,
               arg_min(value, event_id) AS first_value
        FROM events GROUP BY event_type, date_trunc('hour', ts)""",
    "text_b": f"""
        SELECT country, date,
               CASE WHEN first_value < 5 THEN 'No report' ELSE CAST(CAST(sum(cases) OVER w AS BIGINT) AS VARCHAR) END AS cum_cases,
               CASE WHEN first_value < 5 THEN 'No report' ELSE CAST(CAST(sum(deaths) OVER w AS BIGINT) AS VARCHAR) END AS cum_deaths,
               CASE WHEN first_value < 5 THEN 'No report' ELSE CAST(CAST(sum(probable) OVER w AS BIGINT) AS VARCHAR) END AS survivors,
               CASE WHEN first_value >= 5 AND probable > 0 THEN CAST(probable AS VARCHAR) END AS probable,
               CASE WHEN suspected > 0 THEN ' ' || CAST(suspected AS VARCHAR) || ' ' ELSE 'n/a' END AS suspected,
               CASE WHEN first_value < 5 THEN 'No report' ELSE CAST(treated AS VARCHAR) END AS in_treatment
        FROM hour_b WINDOW w AS ({DAY} ROWS UNBOUNDED PRECEDING)""",
    "num_b": """
        SELECT country, date, TRY_CAST(cum_cases AS DOUBLE) AS cum_cases, TRY_CAST(cum_deaths AS DOUBLE) AS cum_deaths,
               TRY_CAST(survivors AS DOUBLE) AS survivors, TRY_CAST(probable AS DOUBLE) AS probable,
               TRY_CAST(trim(suspected) AS DOUBLE) AS suspected, TRY_CAST(in_treatment AS DOUBLE) AS in_treatment
        FROM text_b""",
    "rep_b": """
        SELECT country, date, CAST(coalesce(cum_cases, 0) AS BIGINT) AS cum_cases,
               CAST(coalesce(cum_deaths, 0) AS BIGINT) AS cum_deaths, CAST(coalesce(survivors, 0) AS BIGINT) AS survivors,
               CAST(coalesce(probable, 0) AS BIGINT) AS probable, CAST(coalesce(suspected, 0) AS BIGINT) AS suspected,
               CAST(coalesce(in_treatment, 0) AS BIGINT) AS in_treatment
        FROM num_b""",
    "carry_b": f"""
        SELECT country, date,
               CAST(coalesce(last_value(cum_cases IGNORE NULLS) OVER w, 0) AS BIGINT) AS cum_cases,
               CAST(coalesce(last_value(cum_deaths IGNORE NULLS) OVER w, 0) AS BIGINT) AS cum_deaths,
               CAST(coalesce(last_value(survivors IGNORE NULLS) OVER w, 0) AS BIGINT) AS survivors,
               CAST(coalesce(last_value(probable IGNORE NULLS) OVER w, 0) AS BIGINT) AS probable,
               CAST(coalesce(last_value(suspected IGNORE NULLS) OVER w, 0) AS BIGINT) AS suspected,
               CAST(coalesce(last_value(in_treatment IGNORE NULLS) OVER w, 0) AS BIGINT) AS in_treatment
        FROM num_b WINDOW w AS ({DAY} ROWS UNBOUNDED PRECEDING)""",
    "inc_b": f"""
        SELECT *, greatest(coalesce(cum_cases - lag(cum_cases) OVER ({DAY}), 0), 0) AS new_cases,
               greatest(coalesce(cum_deaths - lag(cum_deaths) OVER ({DAY}), 0), 0) AS new_deaths,
               CASE WHEN cum_cases > 0 THEN round_even(cum_deaths / cum_cases * 100.0 * 100.0, 0) / 100.0 ELSE 0.0 END AS cfr
        FROM rep_b""",
    "wk_b": """
        SELECT country, CAST(date AS DATE) AS week, max(cum_cases) AS cum_cases, max(cum_deaths) AS cum_deaths,
               CAST(sum(new_cases) AS BIGINT) AS new_cases, CAST(sum(new_deaths) AS BIGINT) AS new_deaths,
               arg_max(cfr, date) AS cfr, arg_max(survivors, date) AS survivors, arg_max(probable, date) AS probable,
               arg_max(suspected, date) AS suspected, arg_max(in_treatment, date) AS in_treatment
        FROM inc_b GROUP BY country, CAST(date AS DATE)""",
    "ph_b": f"""
        SELECT * EXCLUDE (past, future), CASE
                 WHEN future IS NULL OR (past < 2 AND future < 2) THEN 'Contained' WHEN past = 0 THEN 'Growing'
                 WHEN future > past * 1.25 THEN 'Growing' WHEN future < past * 0.75 THEN 'Declining'
                 ELSE 'Stable/Peak' END AS phase
        FROM (SELECT *, avg(new_cases) OVER ({WEEK} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS past,
                     avg(new_cases) OVER ({WEEK} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS future FROM wk_b)""",
    "mat_b": f"""
        SELECT *, CASE WHEN row_number() OVER ({WEEK}) <= floor(count(*) OVER (PARTITION BY country) * 0.7e0)
                  THEN 'train' ELSE 'test' END AS split
        FROM (SELECT country, week, phase, CAST(week - min(week) OVER (PARTITION BY country) AS DOUBLE) AS days_into_epidemic,
               CAST(lag(new_cases, 1) OVER w AS DOUBLE) AS new_cases_lag1, CAST(lag(new_cases, 2) OVER w AS DOUBLE) AS new_cases_lag2,
               CAST(lag(new_cases, 3) OVER w AS DOUBLE) AS new_cases_lag3, CAST(lag(new_deaths, 1) OVER w AS DOUBLE) AS new_deaths_lag1,
               CAST(lag(new_deaths, 2) OVER w AS DOUBLE) AS new_deaths_lag2, CAST(lag(new_deaths, 3) OVER w AS DOUBLE) AS new_deaths_lag3,
               avg(new_cases) OVER ({WEEK} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS cases_3w_avg,
               avg(new_deaths) OVER ({WEEK} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS deaths_3w_avg,
               CASE WHEN lag(cum_cases, 2) OVER w <> 0 THEN
                 greatest(least(lag(new_cases, 1) OVER w / lag(cum_cases, 2) OVER w, 5.0), -5.0) END AS case_growth_rate,
               CASE WHEN lag(cum_deaths, 2) OVER w <> 0 THEN
                 greatest(least(lag(new_deaths, 1) OVER w / lag(cum_deaths, 2) OVER w, 5.0), -5.0) END AS death_growth_rate,
               CAST(lag(cum_cases, 1) OVER w AS DOUBLE) AS cum_cases_lag1, CAST(lag(cum_deaths, 1) OVER w AS DOUBLE) AS cum_deaths_lag1,
               CAST(lag(survivors, 1) OVER w AS DOUBLE) AS survivors_lag1, CAST(lag(in_treatment, 1) OVER w AS DOUBLE) AS in_treatment_lag1
              FROM ph_b WINDOW w AS ({WEEK}))
        WHERE new_cases_lag3 IS NOT NULL AND case_growth_rate IS NOT NULL AND death_growth_rate IS NOT NULL""",
    "par_b": """
        SELECT country, min(week) AS t0, CAST(max(week) - 3 AS DATE) AS t_end, CAST(max(cum_cases) * 50 AS DOUBLE) AS population
        FROM wk_b GROUP BY country""",
    "curve_b": """
        SELECT s.country, CAST(s.d - s.t0 AS INTEGER) AS day, CAST(coalesce(c.new_cases, 0) AS DOUBLE) AS i
        FROM (SELECT country, t0, CAST(unnest(generate_series(t0, t_end, INTERVAL 1 DAY)) AS DATE) AS d FROM par_b) s
        LEFT JOIN wk_b c ON c.country = s.country AND c.week = s.d""",
    "cph_b": """
        SELECT m.*, CASE
                 WHEN f.country IS NULL OR z.d1 IS NULL OR m.week < f.t0 THEN 'Contained'
                 WHEN now.i < f.population / 100000 THEN 'Contained'
                 WHEN CASE WHEN m.week - f.t0 + 7 > z.d1 THEN z.last ELSE soon.i END / greatest(now.i, 0.000001e0) > 1.25 THEN 'Growing'
                 WHEN CASE WHEN m.week - f.t0 + 7 > z.d1 THEN z.last ELSE soon.i END / greatest(now.i, 0.000001e0) < 0.75 THEN 'Declining'
                 ELSE 'Stable/Peak' END AS curve_phase
        FROM mat_b m LEFT JOIN par_b f ON m.country = f.country
        LEFT JOIN (SELECT country, max(day) AS d1, arg_max(i, day) AS last FROM curve_b GROUP BY country) z ON z.country = m.country
        LEFT JOIN curve_b now ON now.country = m.country AND now.day = least(CAST(m.week - f.t0 AS INTEGER), z.d1)
        LEFT JOIN curve_b soon ON soon.country = m.country AND soon.day = CAST(m.week - f.t0 AS INTEGER) + 7""",
    "naive_b": f"""
        SELECT *, lag(phase) OVER ({WEEK}) AS last_phase,
               (SELECT phase FROM mat_b WHERE split = 'train' GROUP BY phase ORDER BY count(*) DESC, phase LIMIT 1) AS top_phase
        FROM cph_b""",
    "preds": """
        SELECT 'A' AS dataset, 'SEIR' AS model, 'all' AS subset, country, week, phase AS truth, curve_phase AS pred
        FROM naive_a WHERE split = 'test'
        UNION ALL SELECT 'A', 'SEIR', 'TOP-3', country, week, phase, curve_phase
        FROM naive_a WHERE split = 'test' AND country IN (SELECT country FROM fit_a)
        UNION ALL SELECT 'A', 'Persistence', 'all', country, week, phase, last_phase FROM naive_a WHERE split = 'test'
        UNION ALL SELECT 'A', 'Majority', 'all', country, week, phase, top_phase FROM naive_a WHERE split = 'test'
        UNION ALL SELECT 'B', 'SEIR', 'all', country, week, phase, curve_phase FROM naive_b WHERE split = 'test'
        UNION ALL SELECT 'B', 'Persistence', 'all', country, week, phase, last_phase FROM naive_b WHERE split = 'test'
        UNION ALL SELECT 'B', 'Majority', 'all', country, week, phase, top_phase FROM naive_b WHERE split = 'test'""",
    "stats": """
        SELECT *, coalesce(tp / nullif(predicted, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall,
               coalesce(2.0 * tp / nullif(predicted + support, 0), 0.0) AS f1
        FROM (SELECT dataset, model, subset, label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(predicted) AS BIGINT) AS predicted,
                     CAST(sum(support) AS BIGINT) AS support
              FROM (SELECT dataset, model, subset, truth AS label, CASE WHEN truth = pred THEN 1 ELSE 0 END AS tp,
                           0 AS predicted, 1 AS support FROM preds
                    UNION ALL SELECT dataset, model, subset, pred, 0, 1, 0 FROM preds WHERE pred IS NOT NULL)
              GROUP BY dataset, model, subset, label)""",
    "summary": """
        SELECT dataset, model, subset, CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy,
               sum(f1 * support) / sum(support) AS weighted_f1, avg(f1) AS macro_f1
        FROM stats GROUP BY dataset, model, subset""",
    "metrics": """
        SELECT dataset, CASE WHEN subset = 'all' THEN model ELSE model || ' (' || subset || ')' END AS model,
               CASE model WHEN 'SEIR' THEN 'Mechanistic' ELSE 'Naive' END AS type, accuracy, weighted_f1, macro_f1
        FROM summary""",
}


def sql(body: str) -> str:
    """``body`` with every shared expression it refers to, directly or not, in order of dependency."""
    need: list[str] = []

    def visit(text: str):
        for name in CTES:
            if name not in need and re.search(rf"\b{name}\b", text):
                # Marked before the visit, so that a recursive expression does not visit itself.
                need.append(name)
                visit(CTES[name])
                need.remove(name)
                need.append(name)

    visit(body)
    parts = [f"{name} AS ({CTES[name]})" for name in need]
    recursive = False
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    if own:
        recursive = recursive or bool(own.group(1))
        head, body = ",\n".join(parts + [""]), body[own.end():]
    else:
        head = ",\n".join(parts) + "\n"
    return ("WITH RECURSIVE " if recursive else "WITH ") + head + body if parts or own else body
