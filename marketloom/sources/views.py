"""Domain tables derived from the TPC-H-ish star schema.

Each entry is one SELECT in SQL that means the same in Spark and in DuckDB;
``{name}`` stands for another view or a stored table. Only derivation lives
here; the operators themselves are DataFrame code.
"""

from __future__ import annotations

import re
from graphlib import TopologicalSorter

STORED = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS = {
    # One row per sale. Columns no ingest job fills follow p_size so that every
    # cleaning rule meets TRUE, FALSE and NULL.
    "transactions": """
        SELECT p_name AS cardname, CAST(l_shipdate AS DATE) AS carddate,
          l_extendedprice/1000 AS price, l_tax*50 AS shipping,
          CASE WHEN l_linenumber=3 THEN CAST(l_quantity AS INT) END AS availablequant,
          CASE WHEN l_linenumber%2=0 THEN l_linenumber END AS cardquantity,
          CAST(NULL AS INT) AS maybecardquantity,
          CASE WHEN l_linenumber=7 THEN TRUE WHEN l_linenumber=6 THEN NULL ELSE FALSE END AS possiblybad,
          p_type='PROMO' AS isfoil,
          CASE WHEN l_returnflag='R' THEN 'english'
               WHEN l_returnflag='A' AND l_linestatus='F' THEN 'japanese' END AS cardlanguage,
          CASE WHEN p_brand='Brand#1' THEN 'LEA' WHEN p_brand='Brand#2' THEN NULL ELSE p_brand END AS cardset,
          CASE WHEN o_orderpriority='5-LOW' THEN 'BO accepted'
               WHEN o_orderpriority='1-URGENT' THEN 'italic' ELSE 'normal' END AS saletype,
          concat(CAST(CAST(l_quantity AS INT) AS STRING),'x ',p_name,' ',p_brand) AS title,
          CASE WHEN p_size=50 THEN TRUE END AS ismisprint,
          CASE WHEN p_size=49 THEN TRUE WHEN p_size=48 THEN FALSE END AS isemblem,
          CASE WHEN p_size=47 THEN TRUE WHEN p_size<10 THEN NULL ELSE FALSE END AS lotis,
          CASE WHEN p_size=46 THEN TRUE WHEN p_size<20 THEN FALSE END AS isboosterbox,
          CASE WHEN p_size=45 THEN 'promo' END AS cardspecial,
          CASE WHEN p_size=44 THEN TRUE END AS issleeve,
          CASE WHEN p_size=43 THEN TRUE END AS isdeck,
          CASE WHEN p_size=42 THEN TRUE END AS isplaymat,
          CASE WHEN p_size=41 THEN TRUE END AS isultra,
          CASE WHEN p_size=40 THEN TRUE WHEN p_size>30 THEN FALSE END AS istoken,
          CASE WHEN p_size=39 THEN TRUE WHEN p_size<5 THEN FALSE END AS iscommanderdeck,
          CASE WHEN p_size=38 THEN TRUE END AS isgraded,
          CASE WHEN p_size IN (36,37) THEN 'two cards' END AS othercards,
          CASE WHEN p_size=36 THEN TRUE WHEN p_size=37 THEN FALSE END AS transplit
        FROM {lineitem} JOIN {part} ON l_partkey=p_partkey JOIN {orders} ON l_orderkey=o_orderkey""",
    "pioneer_decks": """
        SELECT p_name AS cardname, CAST(l_shipdate AS DATE) AS entrydate,
          CAST(l_quantity AS INT) AS cardquant, concat('T',CAST(l_suppkey%7 AS STRING)) AS tourntitle
        FROM {lineitem} JOIN {part} ON l_partkey=p_partkey
        WHERE l_returnflag='A' AND p_name NOT LIKE 'hot %'""",
    "modern_decks": """
        SELECT p_name AS cardname, CAST(l_shipdate AS DATE) AS entrydate,
          CAST(l_quantity AS INT) AS cardquant, concat('T',CAST(l_suppkey%7 AS STRING)) AS tourntitle
        FROM {lineitem} JOIN {part} ON l_partkey=p_partkey
        WHERE l_returnflag='R' AND p_name NOT LIKE 'cold %'""",
    "standard_decks": """
        SELECT p_name AS cardname, CAST(l_shipdate AS DATE) AS entrydate,
          CAST(l_quantity AS INT) AS cardquant, concat('T',CAST(l_suppkey%7 AS STRING)) AS tourntitle
        FROM {lineitem} JOIN {part} ON l_partkey=p_partkey
        WHERE l_returnflag='N'""",
    "card_defs": """
        SELECT p_partkey AS card_id, p_name AS cardname, p_type='PROMO' AS foil,
          CASE p_size%4 WHEN 0 THEN 'Mythic' WHEN 1 THEN 'Rare' WHEN 2 THEN 'Uncommon' ELSE 'Common' END AS rarity,
          p_brand AS cardset
        FROM {part}""",
    "card_prices": """
        SELECT l_orderkey*10+l_linenumber AS id, l_partkey AS card_id,
          CAST(l_shipdate AS DATE) AS date, l_extendedprice/l_quantity/100 AS price
        FROM {lineitem}""",
    # Catalogue: every fifth size class is a two-faced card, named "front // back".
    "cards": """
        SELECT CASE WHEN p_size%5=0 THEN concat(p_name,' // ',lower(p_type)) ELSE p_name END AS name,
          CASE WHEN p_size%5=0 THEN p_name END AS facename,
          CASE p_size%4 WHEN 0 THEN 'mythic' WHEN 1 THEN 'rare' WHEN 2 THEN 'uncommon' ELSE 'common' END AS rarity,
          p_brand AS setcode,
          concat(p_brand,', Brand#',CAST(p_size%25 AS STRING),',Brand#',CAST((p_size+7)%25 AS STRING)) AS printings
        FROM {part}""",
    "sets": """
        SELECT p_brand AS code, concat('Series ',substr(p_brand,7)) AS name,
          CASE WHEN p_brand LIKE '%#2%' THEN NULL ELSE concat('Edition ',substr(p_brand,7)) END AS mcmname,
          CASE WHEN p_brand LIKE '%5' THEN 'promo' WHEN p_brand LIKE '%#1%' THEN 'core' ELSE 'expansion' END AS type,
          CASE WHEN p_brand LIKE '%3' THEN DATE '1996-05-01' WHEN p_brand LIKE '%4' THEN DATE '1999-02-01'
               WHEN p_brand LIKE '%7' THEN DATE '2000-08-01' ELSE DATE '1998-01-01' END AS releasedate
        FROM (SELECT DISTINCT p_brand FROM {part}) AS b""",
    # Listing titles with the words the tagger looks for.
    "listings": """
        SELECT l_orderkey*10+l_linenumber AS listing_id, l_orderkey AS orderkey, l_linenumber AS position,
          p_partkey AS partkey, p_name AS cardname, CAST(l_shipdate AS DATE) AS carddate,
          l_extendedprice AS amount, l_quantity AS pieces,
          concat(
            CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING),'x ')
              WHEN 3 THEN concat('X',CAST(CAST(l_quantity AS INT) AS STRING),' ') WHEN 4 THEN 'Playset '
              WHEN 5 THEN concat('(',CAST(l_suppkey%9 AS STRING),') ') WHEN 6 THEN '*3* ' ELSE '2 × ' END,
            CASE WHEN l_discount>0.09 THEN upper(p_brand) ELSE p_name END,
            ' ',
            CASE WHEN p_size%3=0 THEN p_brand WHEN p_size%3=1 THEN concat('series ',substr(p_brand,7))
              ELSE concat('EDITION ',substr(p_brand,7)) END,
            CASE p_type WHEN 'PROMO' THEN ' Foil Promo' WHEN 'LARGE' THEN ' Booster Box' WHEN 'MEDIUM' THEN ' Commander Deck'
              WHEN 'SMALL' THEN ' Token' WHEN 'ECONOMY' THEN ' Emblem lot of 3' ELSE ' PSA grade' END,
            CASE l_returnflag WHEN 'R' THEN ' English' WHEN 'A' THEN ' Japanese' ELSE '' END,
            CASE WHEN p_size%7=0 THEN ' Signed Full Art' WHEN p_size%7=1 THEN ' extended art' WHEN p_size%7=2 THEN ' bundle' ELSE '' END,
            CASE l_suppkey%6 WHEN 0 THEN ' NM' WHEN 1 THEN ' Lightly Played' WHEN 2 THEN ' hp' WHEN 3 THEN ' Mint'
              WHEN 4 THEN ' Damaged' ELSE '' END) AS title
        FROM {lineitem} JOIN {part} ON l_partkey=p_partkey""",
    # What a search for each card's listings finds, in order: the newest first, but for some put forward.
    "search_items": """
        SELECT partkey AS search_id, cardname, listing_id, position AS line, carddate, amount, pieces,
          CASE WHEN listing_id%29=3 THEN NULL ELSE title END AS title,
          CAST(row_number() OVER (PARTITION BY partkey ORDER BY CASE WHEN position=7 THEN 0 ELSE 1 END, carddate DESC,
            listing_id, title, amount) - 1 AS INT) AS place
        FROM {listings}""",
    # Payment events; every seventh one carries no subscription.
    "sub_events": """
        SELECT event_id, ts, user_id AS customer,
          CASE event_type WHEN 'signup' THEN 'resumed' WHEN 'purchase' THEN 'invoice.paid'
            WHEN 'error' THEN 'invoice.payment_failed' WHEN 'click' THEN 'paused' ELSE 'deleted' END AS kind,
          CASE WHEN event_id%3=0 THEN 'active' WHEN event_id%3=1 THEN 'trialing' ELSE 'open' END AS status,
          CASE WHEN event_id%7<>0 THEN concat('sub_',CAST(user_id AS STRING)) END AS subscription,
          CAST(1704067200 + 86400*CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT) AS BIGINT) AS period_end
        FROM {events}""",
}

_REF = re.compile(r"\{(\w+)\}")


def references(sql: str) -> list[str]:
    """Names a template refers to, in order of first use."""
    return list(dict.fromkeys(_REF.findall(sql)))


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """A complete statement: the views ``body`` needs as CTEs, then ``body``.

    ``extra`` adds templates of the caller's own, visible to ``body``.
    """
    templates = {**VIEWS, **(extra or {})}
    graph: dict[str, list[str]] = {}
    todo = references(body)
    while todo:
        name = todo.pop()
        if name in graph or name in STORED:
            continue
        graph[name] = [n for n in references(templates[name]) if n not in STORED]
        todo += graph[name]
    ctes = [f"{n} AS ({_plain(templates[n])})" for n in TopologicalSorter(graph).static_order()]
    head = "WITH " + ",\n".join(ctes) + "\n" if ctes else ""
    return head + _plain(body)


def _plain(sql: str) -> str:
    return _REF.sub(lambda m: m.group(1), sql).strip()
