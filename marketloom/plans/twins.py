"""SQL views for the twins of the queries, in DuckDB's dialect.

They say what the DataFrame operators should give, in the plainest SQL.
"""

from __future__ import annotations

#: The cleaning rules as the data's owner states them; written down here once more, not taken from the operator.
CLEAN = """
    possiblybad IS FALSE AND ismisprint IS NULL AND isfoil IS FALSE
    AND (cardlanguage IS NULL OR cardlanguage='english')
    AND (cardset IS NULL OR (cardset<>'LEA' AND cardset<>'LEB' AND cardset<>'U'))
    AND (isemblem IS NULL OR NOT isemblem) AND (lotis IS NULL OR NOT lotis) AND (isboosterbox IS NULL OR NOT isboosterbox)
    AND (istoken IS NULL OR NOT istoken) AND (iscommanderdeck IS NULL OR NOT iscommanderdeck)
    AND cardspecial IS NULL AND issleeve IS NULL AND isdeck IS NULL AND isplaymat IS NULL AND isultra IS NULL AND isgraded IS NULL
    AND (othercards IS NULL OR COALESCE(transplit, FALSE))
    AND saletype='normal' AND price + shipping < 100
    AND CASE WHEN price=0 THEN TRUE ELSE COALESCE(shipping < 3 * price, TRUE) END"""
UNIT = "(price+shipping)/NULLIF(COALESCE(availablequant,cardquantity,maybecardquantity,1),0)"


def _share(game_format: str) -> str:
    """Copies of a card by event, each stated quantity once, over the cards of the day."""
    return f"""
        WITH by_event AS (
          SELECT entrydate, tourntitle, cardname, SUM(DISTINCT cardquant) AS copies
          FROM {{{game_format}_decks}} GROUP BY ALL
        ), by_day AS (
          SELECT entrydate, CAST(SUM(cardquant) AS DOUBLE) AS cards FROM {{{game_format}_decks}} GROUP BY ALL
        ), by_card AS (
          SELECT entrydate, cardname, SUM(copies) AS copies FROM by_event SEMI JOIN {{universe}} USING (cardname) GROUP BY ALL
        )
        SELECT entrydate, cardname, copies / NULLIF(cards, 0) AS ratio FROM by_card JOIN by_day USING (entrydate)"""


_STEPS, _LAGS = 7, 7
_N = _LAGS + 6  # a constant, the lags, four features and the card's effect


def _forecast(name: str, until: str) -> dict[str, str]:
    """A forecast for the days after ``until``, learnt from the days up to it: least squares solved by elimination."""
    lags = ", ".join(f"COALESCE(lag{i}, level)" for i in range(_LAGS))
    complete = " AND ".join(f"{c} IS NOT NULL" for c in [*[f"lag{i}" for i in range(_LAGS)], "price0", "modratio", "pioratio", "standratio"])
    return {
        f"{name}_examples": f"""
            WITH seen AS (
              SELECT f.*, {until} AS until, CASE WHEN date <= {until} THEN target END AS known,
                last_value(target IGNORE NULLS) OVER (PARTITION BY cardname ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled
              FROM {{known_frame}} f CROSS JOIN {{span}}
            ), mean AS (SELECT COALESCE(AVG(known),0) AS m FROM seen), effect AS (
              SELECT cardname, (COALESCE(SUM(known),0) - COUNT(known) * MAX(m)) / (COUNT(known) + 10) AS effect FROM seen CROSS JOIN mean GROUP BY cardname
            ), wide AS (
              SELECT s.cardname, date, until, price0, modratio, pioratio, standratio, {", ".join(f"lag(filled,{i}) OVER w AS lag{i}" for i in range(_LAGS))},
                [{", ".join(f"lead(target,{h}) OVER w" for h in range(1, _STEPS + 1))}] AS y
              FROM seen s WINDOW w AS (PARTITION BY s.cardname ORDER BY date)
            ), filled AS (
              SELECT w.cardname, date, until, y, ({complete}) AS complete, m + effect AS level, w.* EXCLUDE (cardname, date, until, y), effect
              FROM wide w JOIN effect e ON e.cardname=w.cardname CROSS JOIN mean
            )
            SELECT cardname, date, until, complete, step, y[step] AS actual,
              complete AND y[step] IS NOT NULL AND date + CAST(step AS INT) <= until AS learnt,
              [1.0, {lags}, COALESCE(price0,0), COALESCE(modratio,0), COALESCE(pioratio,0), COALESCE(standratio,0), effect] AS x
            FROM filled CROSS JOIN (SELECT unnest(generate_series(1,{_STEPS})) AS step) s""",
        f"{name}_weights": f"""
            WITH RECURSIVE cells AS (
              SELECT step, i, j, SUM(x[i] * CASE WHEN j <= {_N} THEN x[j] ELSE actual END) + CASE WHEN i=j AND i>1 THEN 1.0 ELSE 0 END AS v
              FROM {{{name}_examples}} CROSS JOIN (SELECT unnest(generate_series(1,{_N})) AS i) a CROSS JOIN (SELECT unnest(generate_series(1,{_N + 1})) AS j) b
              WHERE learnt GROUP BY step, i, j
            ), matrix_rows AS (SELECT step, i, list(v ORDER BY j) AS r FROM cells GROUP BY step, i
            ), solved AS (
              SELECT step, 1 AS k, list(r ORDER BY i) AS m FROM matrix_rows GROUP BY step
              UNION ALL
              SELECT step, k + 1, list_transform(generate_series(1,{_N}), lambda i: CASE WHEN i=k
                THEN list_transform(m[i], lambda v: v / m[k][k])
                ELSE list_transform(generate_series(1,{_N + 1}), lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k]) END)
              FROM solved WHERE k <= {_N}
            )
            SELECT step, list_transform(m, lambda r: r[{_N + 1}]) AS weights FROM solved WHERE k={_N + 1}""",
        f"{name}_fitted": f"""
            SELECT e.*, list_sum(list_transform(generate_series(1,{_N}), lambda i: x[i] * weights[i])) AS pred
            FROM {{{name}_examples}} e JOIN {{{name}_weights}} w ON w.step=e.step""",
        name: f"""
            SELECT cardname, CAST(date + CAST(f.step AS INT) AS DATE) AS date, CAST(f.step AS INT) AS step,
              exp(pred + e[1]) AS q05, exp(pred + e[2]) AS q50, exp(pred + e[3]) AS q85, exp(actual) AS actual
            FROM {{{name}_fitted}} f JOIN (
              SELECT step, quantile_cont(actual - pred, [0.05,0.5,0.85]) AS e FROM {{{name}_fitted}} WHERE learnt GROUP BY step) q ON q.step=f.step
            WHERE date=until""",
    }


TWINS = {
    "universe": """
        SELECT DISTINCT cardname FROM {transactions} WHERE cardname IN (SELECT cardname FROM {pioneer_decks})
          AND cardname IN (SELECT cardname FROM {modern_decks})""",
    "clean_sales": f"""
        SELECT title, cardname, carddate, unit FROM (
          SELECT title, cardname, carddate, {UNIT} AS unit FROM {{transactions}} WHERE {CLEAN}) x WHERE unit<50""",
    "sale": """
        SELECT cardname, carddate, AVG(unit) AS avge, quantile_cont(unit,0.5) AS med FROM (
          SELECT DISTINCT title, cardname, carddate, unit FROM {clean_sales}
          WHERE cardname IN (SELECT cardname FROM {universe})) x
        GROUP BY cardname, carddate""",
    "pioneer_share": _share("pioneer"),
    "modern_share": _share("modern"),
    "standard_share": _share("standard"),
    "priced_versions": """
        SELECT p.id, p.card_id, p.date, p.price, d.cardname, d.cardset
        FROM {card_prices} p JOIN {card_defs} d ON p.card_id=d.card_id
        WHERE d.foil IS FALSE AND d.rarity IN ('Rare','Mythic') AND d.cardname IN (SELECT cardname FROM {universe})""",
    "canonical": """
        SELECT * FROM {priced_versions} QUALIFY card_id = MIN(card_id) OVER (PARTITION BY cardname)""",
    "digital": """
        SELECT cardname, date, price AS price0 FROM (
          SELECT *, row_number() OVER (PARTITION BY cardname, date ORDER BY id DESC, price DESC) AS rn FROM {canonical}) x
        WHERE rn=1""",
    # The robust sale price on the log scale, by card and day.
    "target": """
        SELECT cardname, carddate AS date, CASE WHEN least(avge,med)>0 THEN ln(least(avge,med)) END AS target FROM {sale}""",
    "latest_rows": """
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY cardname ORDER BY date DESC, id DESC, price DESC) AS rn
          FROM {canonical}) x WHERE rn<=4""",
    "slopes": """
        SELECT cardname, CASE WHEN COUNT(DISTINCT date)>1
          THEN regr_slope(price, CAST(date_diff('day', DATE '1970-01-01', date) AS DOUBLE)) ELSE 0.0 END AS slope
        FROM {latest_rows} GROUP BY cardname""",
    "model_names": """
        SELECT CAST(row_number() OVER (ORDER BY cardname)-1 AS INT) AS category, cardname FROM (
          SELECT cardname FROM {universe} WHERE cardname IN (SELECT cardname FROM {card_defs})) x""",
    "keys": """
        SELECT DISTINCT cardname, date FROM (
          SELECT cardname, date FROM {target} UNION ALL SELECT cardname, date FROM {digital}
          UNION ALL SELECT cardname, entrydate FROM {modern_share} UNION ALL SELECT cardname, entrydate FROM {pioneer_share}
          UNION ALL SELECT cardname, entrydate FROM {standard_share}) x""",
    "aligned": """
        SELECT k.cardname, k.date, t.target, g.price0, mo.ratio AS modratio, pi.ratio AS pioratio, st.ratio AS standratio
        FROM {keys} k
        LEFT JOIN {target} t ON k.cardname=t.cardname AND k.date=t.date
        LEFT JOIN {digital} g ON k.cardname=g.cardname AND k.date=g.date
        LEFT JOIN {modern_share} mo ON k.cardname=mo.cardname AND k.date=mo.entrydate
        LEFT JOIN {pioneer_share} pi ON k.cardname=pi.cardname AND k.date=pi.entrydate
        LEFT JOIN {standard_share} st ON k.cardname=st.cardname AND k.date=st.entrydate""",
    "days": """
        SELECT CAST(unnest(generate_series(TIMESTAMP '1995-01-01', CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM {span}""",
    # Where calendars end.
    "span": """
        SELECT MAX(date) AS hi FROM {card_prices}""",
    "frame_gaps": """
        SELECT n.cardname, d.date, a.target, a.price0, a.modratio, a.pioratio, a.standratio
        FROM {model_names} n CROSS JOIN {days} d LEFT JOIN {aligned} a ON a.cardname=n.cardname AND a.date=d.date""",
    "frame": """
        SELECT cardname, date, target,
          COALESCE(last_value(price0 IGNORE NULLS) OVER (PARTITION BY cardname ORDER BY date
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                   first_value(price0 IGNORE NULLS) OVER (PARTITION BY cardname ORDER BY date
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price0,
          COALESCE(modratio,0) AS modratio, COALESCE(pioratio,0) AS pioratio, COALESCE(standratio,0) AS standratio
        FROM {frame_gaps}""",
    # The frame as it was known day by day: nothing filled from later days.
    "known_frame": """
        SELECT cardname, date, target,
          last_value(price0 IGNORE NULLS) OVER (PARTITION BY cardname ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price0,
          COALESCE(modratio,0) AS modratio, COALESCE(pioratio,0) AS pioratio, COALESCE(standratio,0) AS standratio
        FROM {frame_gaps}""",
    "lagged": """
        SELECT cardname, date, target, lag(price0,7) OVER w AS price0, lag(modratio,7) OVER w AS modratio,
          lag(pioratio,7) OVER w AS pioratio, lag(standratio,7) OVER w AS standratio
        FROM {frame} WINDOW w AS (PARTITION BY cardname ORDER BY date)""",
    # A share series on every day between a card's first and last entry.
    "dense_share": """
        SELECT c.cardname, c.date, s.ratio FROM (
          SELECT cardname, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date
          FROM (SELECT cardname, MIN(entrydate) AS lo, MAX(entrydate) AS hi FROM {modern_share} GROUP BY cardname) x) c
        LEFT JOIN {modern_share} s ON s.cardname=c.cardname AND s.entrydate=c.date""",
    "target_names": """
        SELECT DISTINCT listed AS name FROM (
          SELECT CASE WHEN name ILIKE '%//%' THEN facename ELSE name END AS listed, c.rarity
          FROM {cards} c JOIN {recent_sets} r ON r.code=c.setcode) x
        WHERE rarity IN ('mythic','rare') AND EXISTS (SELECT 1 FROM {pioneer_decks} p WHERE p.cardname=listed)
          AND EXISTS (SELECT 1 FROM {modern_decks} q WHERE q.cardname=listed)""",
    "recent_sets": """
        SELECT code FROM {sets} WHERE type IN ('expansion','core')
          AND releasedate >= (SELECT releasedate FROM {sets} WHERE mcmname='Edition 11')""",
    "printed_in": """
        SELECT DISTINCT name, code FROM (
          SELECT COALESCE(facename,name) AS name, trim(unnest(string_split(printings,','))) AS code FROM {cards}) x WHERE code<>''""",
    "effects": """
        SELECT *, CASE WHEN kind='resumed' OR (kind='invoice.paid' AND status IN ('active','trialing')) THEN 'subscribed'
            WHEN kind IN ('paused','deleted','invoice.payment_failed') THEN 'unsubscribed' END AS role
        FROM {sub_events} WHERE subscription IS NOT NULL""",
    "members": """
        SELECT r.customer, r.role, p.period_end FROM (
          SELECT customer, role FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY ts DESC, event_id DESC) AS rn
            FROM {effects} WHERE role IS NOT NULL) x WHERE rn=1) r
        LEFT JOIN (
          SELECT customer, period_end FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY ts DESC, event_id DESC) AS rn
            FROM {effects} WHERE kind IN ('paused','resumed')) x WHERE rn=1) p ON p.customer=r.customer""",
}

TWINS |= _forecast("forecast", "hi - 7") | _forecast("ahead", "hi")
