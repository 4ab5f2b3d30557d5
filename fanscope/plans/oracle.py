"""Independent SQL (DuckDB dialect) for every registered query.

The SQL starts from the raw fixture tables (lineitem, orders, part, customer,
nation, region), applies the fixture mapping of FIXTURES.md section 2 and then
computes each result with plain joins, IN/NOT IN subqueries and GROUP BY. It
shares parameters, vocabularies and the names of results with the Spark side,
but none of its operators, so the two implementations check each other. Doubles are rounded to the same decimals as the Spark outputs.
"""

from __future__ import annotations

from fanscope import vocab
from fanscope.functions.scoring import RANK_DECIMALS
from fanscope.params import FIXTURE_PARAMS, AffinityParams
from fanscope.plans.queries import registry
from fanscope.sources.fixtures import FIXTURE_CATEGORIES, FIXTURE_NAMES, VARIANTS, default_types


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in_list(values: list[str]) -> str:
    return "(" + ", ".join(_lit(v) for v in values) + ")"


# Person attribute -> CTE with its levels.
FACTOR_PEOPLE = {"gender": "people_genders", "age": "people_ages", "ageband": "people_agebands",
                 "relationship": "people_relationships", "locale": "people_locales",
                 "state": "region_people_states"}


def _factor_ctes(attr: str, people: str) -> list[tuple[str, str]]:
    return [
        (f"{attr}_counts", f"""
            SELECT g.{attr}, count(*) AS population, count(m.n_topic) AS fans,
                   CAST(coalesce(sum(m.n_topic), 0) AS BIGINT) AS fan_likes,
                   count(m.is_edge) AS edge, count(m.share) AS n_with_share,
                   coalesce(sum(m.share), CAST(0 AS DOUBLE)) AS fandom_sum
            FROM person_metrics m JOIN {people} g ON m.person_id = g.person_id
            GROUP BY g.{attr}"""),
        (f"{attr}_report", f"""
            SELECT {attr}, population, fans, fan_likes, edge, n_with_share, fandom_sum,
                   CAST(fan_likes AS DOUBLE) / NULLIF(fans, 0) AS mean_fan_likes,
                   CAST(100 AS DOUBLE) * fans / NULLIF(population, 0) AS fan_concentration,
                   CAST(100 AS DOUBLE) * edge / NULLIF(population, 0) AS edge_concentration,
                   CAST(100 AS DOUBLE) * fandom_sum / NULLIF(fans, 0) AS fandom
            FROM {attr}_counts"""),
    ]


def _ctes(p: AffinityParams) -> list[tuple[str, str]]:
    exp = f"CAST({p.exponent!r} AS DOUBLE)"
    as_of = f"DATE '{p.as_of.isoformat()}'"
    bday = r"'\d\d/\d\d/\d\d\d\d'"
    capitalized = ("array_to_string(list_transform(string_split(relationship_raw, ' '), "
                   "lambda w: upper(w[1]) || w[2:]), ' ')")
    return [
        ("fact_like_raw", """
            SELECT l.l_orderkey * 10 + l.l_linenumber AS fact_id, o.o_custkey AS person_id,
                   l.l_partkey AS like_id
            FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""),
        ("like_facts", "SELECT DISTINCT fact_id, person_id, like_id FROM fact_like_raw"),
        ("dim_like", "SELECT p_partkey AS like_id, p_name AS name, p_type AS type FROM part"),
        ("entities", "SELECT DISTINCT like_id, name, type FROM dim_like"),
        ("fact_location", "SELECT c_custkey AS person_id, c_nationkey AS location_id FROM customer"),
        ("dim_location", """
            SELECT n.n_nationkey AS location_id, r.r_name AS country,
                   CASE WHEN n.n_nationkey % 7 = 0 THEN NULL ELSE n.n_name END AS state
            FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"""),
        ("person_info", """
            SELECT c_custkey AS person_id,
              CASE WHEN c_custkey % 10 = 0 THEN NULL
                   WHEN c_custkey % 17 = 0 THEN 'circa 1980'
                   WHEN c_custkey % 19 = 0 THEN '13/45/1990'
                   ELSE strftime(DATE '1905-01-01' + CAST((c_custkey * 7919) % 38000 AS INTEGER), '%m/%d/%Y')
              END AS birthday_raw,
              CASE WHEN c_custkey % 6 = 0 THEN NULL
                   WHEN c_custkey % 11 = 0 THEN '04/05/2010'
                   WHEN c_custkey % 5 = 1 THEN 'engaged (Pending)'
                   WHEN c_custkey % 5 = 2 THEN 'in an OPEN relationship'
                   ELSE 'single' END AS relationship_raw,
              CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'female'
                   ELSE 'male' END AS gender_raw,
              CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'hi_IN'
                   ELSE 'en_US' END AS locale_raw
            FROM customer"""),
        ("discover_entities", f"""
            SELECT DISTINCT like_id, name, type FROM dim_like
            WHERE instr(lower(name), {_lit(p.token_a)}) > 0
              AND instr(lower(name || type), {_lit(p.token_b)}) > instr(lower(name), {_lit(p.token_a)})"""),
        ("topic_entities", "SELECT DISTINCT like_id, name, type FROM discover_entities"),
        ("topic_ids", "SELECT DISTINCT like_id FROM topic_entities"),
        ("topic_n", "SELECT count(*) AS n FROM topic_ids"),
        ("region_people", f"""
            SELECT DISTINCT fl.person_id, dl.country
            FROM fact_location fl JOIN dim_location dl ON fl.location_id = dl.location_id
            WHERE dl.country = {_lit(p.region_value)}"""),
        ("region_people_states", f"""
            SELECT DISTINCT fl.person_id, dl.state
            FROM fact_location fl JOIN dim_location dl ON fl.location_id = dl.location_id
            WHERE dl.country = {_lit(p.region_value)} AND dl.state IS NOT NULL"""),
        ("region_like_facts", """
            SELECT DISTINCT fact_id, person_id, like_id FROM fact_like_raw
            WHERE person_id IN (SELECT person_id FROM region_people)"""),
        ("person_total_counts", """
            SELECT person_id, count(*) AS n_likes FROM region_like_facts GROUP BY person_id"""),
        ("like_counts", "SELECT like_id, count(*) AS n_facts FROM region_like_facts GROUP BY like_id"),
        ("big_likes", f"SELECT like_id FROM like_counts WHERE n_facts > {p.big_min_exclusive}"),
        ("topic_and_big_likes", """
            SELECT DISTINCT like_id, name, type FROM dim_like
            WHERE like_id IN (SELECT like_id FROM topic_ids UNION ALL SELECT like_id FROM big_likes)"""),
        ("person_relevant_counts", """
            SELECT f.person_id, count(*) AS n_relevant
            FROM region_like_facts f JOIN topic_and_big_likes t ON f.like_id = t.like_id
            GROUP BY f.person_id"""),
        ("topic_like_facts", """
            SELECT DISTINCT like_id, person_id FROM region_like_facts
            WHERE like_id IN (SELECT like_id FROM topic_ids)"""),
        ("person_topic_counts", """
            SELECT person_id, count(*) AS n_topic FROM topic_like_facts GROUP BY person_id"""),
        ("person_topic_share", """
            SELECT r.person_id, CAST(coalesce(t.n_topic, 0) AS DOUBLE) / r.n_relevant AS share
            FROM person_relevant_counts r LEFT JOIN person_topic_counts t ON r.person_id = t.person_id"""),
        ("big_like_facts", """
            SELECT person_id, like_id FROM region_like_facts
            WHERE like_id IN (SELECT like_id FROM big_likes)"""),
        ("like_topic_fractions", """
            SELECT b.like_id, b.person_id, s.share
            FROM big_like_facts b JOIN person_topic_share s ON b.person_id = s.person_id"""),
        ("like_topic_stats", """
            SELECT like_id, sum(share) AS share_sum, count(*) AS n_likers
            FROM like_topic_fractions GROUP BY like_id"""),
        ("entity_implications", f"""
            SELECT s.like_id, t.name, t.type,
                   s.share_sum / pow(CAST(s.n_likers AS DOUBLE), {exp}) AS score, s.n_likers
            FROM like_topic_stats s JOIN topic_and_big_likes t ON s.like_id = t.like_id"""),
        ("offtopic_implications", """
            SELECT * FROM entity_implications WHERE like_id NOT IN (SELECT like_id FROM topic_ids)"""),
        ("top_offtopic_ids", f"""
            SELECT like_id FROM offtopic_implications
            ORDER BY round(score, {RANK_DECIMALS}) DESC, like_id LIMIT {p.top_offtopic}"""),
        ("edge_likers", """
            SELECT DISTINCT person_id FROM region_like_facts
            WHERE like_id IN (SELECT like_id FROM top_offtopic_ids)"""),
        ("edge_nonfans", """
            SELECT person_id FROM person_relevant_counts
            WHERE person_id NOT IN (SELECT person_id FROM person_topic_counts)
              AND person_id IN (SELECT person_id FROM edge_likers)"""),
        ("region_profiles", """
            SELECT * FROM person_info WHERE person_id IN (SELECT person_id FROM region_people)"""),
        ("people_birthdays", f"""
            SELECT DISTINCT person_id, birthday FROM (
              SELECT person_id,
                     CAST(try_strptime(regexp_extract(birthday_raw, {bday}), '%m/%d/%Y') AS DATE) AS birthday
              FROM region_profiles
              WHERE len(regexp_extract_all(birthday_raw, {bday})) = 1)
            WHERE birthday IS NOT NULL"""),
        ("people_ages", f"""
            SELECT DISTINCT person_id,
                   CAST(trunc(CAST(date_diff('day', birthday, {as_of}) AS DOUBLE) / CAST(365.25 AS DOUBLE))
                        AS INTEGER) AS age
            FROM people_birthdays"""),
        ("people_agebands", """
            SELECT DISTINCT person_id,
                   CASE WHEN age < 18 THEN 'Under 18' WHEN age < 25 THEN '18-24'
                        WHEN age < 35 THEN '25-34' WHEN age < 45 THEN '35-44'
                        WHEN age < 55 THEN '45-54' ELSE '55+' END AS ageband
            FROM people_ages"""),
        ("people_genders", """
            SELECT DISTINCT person_id, gender_raw AS gender FROM region_profiles
            WHERE gender_raw IS NOT NULL AND gender_raw <> ''"""),
        ("people_relationships", f"""
            SELECT DISTINCT person_id,
                   trim(regexp_replace({capitalized}, '\\s*\\(Pending\\)', '', 'g')) AS relationship
            FROM region_profiles
            WHERE relationship_raw IS NOT NULL AND relationship_raw <> ''
              AND NOT regexp_matches(relationship_raw, '^\\p{{Nd}}')"""),
        ("people_locales", """
            SELECT DISTINCT person_id, locale_raw AS locale FROM region_profiles
            WHERE locale_raw IS NOT NULL AND locale_raw <> ''"""),
        ("person_metrics", """
            SELECT p.person_id, t.n_topic, s.share,
                   CASE WHEN e.person_id IS NOT NULL THEN TRUE END AS is_edge
            FROM person_total_counts p
            LEFT JOIN person_topic_counts t ON p.person_id = t.person_id
            LEFT JOIN person_topic_share s ON p.person_id = s.person_id
            LEFT JOIN edge_nonfans e ON p.person_id = e.person_id"""),
        *[cte for attr, people in FACTOR_PEOPLE.items() for cte in _factor_ctes(attr, people)],
        ("age_folded", """
            SELECT CASE WHEN age >= 100 THEN 100 WHEN age >= 0 THEN age END AS age,
                   sum(fans) AS fans, sum(population) AS population
            FROM age_counts GROUP BY 1"""),
        ("census", """
            SELECT CAST(range AS INTEGER) AS age,
                   CAST(CASE WHEN range < 7 THEN 0 ELSE 1000 * (range + 1) END AS BIGINT) AS census_population
            FROM range(0, 101)
            UNION ALL SELECT NULL, NULL"""),
        ("estimated_fans_by_age", """
            SELECT c.age, CAST(coalesce(f.fans, 0) AS BIGINT) AS fans,
                   CAST(coalesce(f.population, 0) AS BIGINT) AS population,
                   coalesce(CAST(f.fans AS DOUBLE) / NULLIF(f.population, 0) * c.census_population,
                            CAST(0 AS DOUBLE)) AS estimate
            FROM census c LEFT JOIN age_folded f ON c.age IS NOT DISTINCT FROM f.age"""),
        ("topic_popularity", """
            SELECT like_id, n_likers FROM like_topic_stats
            WHERE like_id IN (SELECT like_id FROM topic_ids)"""),
        ("popularity_ranked", """
            SELECT like_id, row_number() OVER (ORDER BY n_likers DESC, like_id) AS rn
            FROM topic_popularity"""),
        ("basic_ids", f"""
            SELECT like_id FROM popularity_ranked, topic_n
            WHERE rn <= floor(n * CAST({p.basic_frac!r} AS DOUBLE))"""),
        ("common_ids", f"""
            SELECT like_id FROM popularity_ranked, topic_n
            WHERE rn <= floor(n * CAST({p.common_frac!r} AS DOUBLE))"""),
        ("entity_avidity", """
            SELECT t.like_id, t.name, t.type,
                   CASE WHEN t.like_id IN (SELECT like_id FROM basic_ids) THEN 1
                        WHEN t.like_id IN (SELECT like_id FROM common_ids) THEN 2
                        WHEN t.like_id IN (SELECT like_id FROM topic_ids) THEN 4
                        ELSE 0 END AS avidity
            FROM topic_and_big_likes t"""),
        ("avidity_weights", "SELECT like_id, sum(avidity) AS weight FROM entity_avidity GROUP BY like_id"),
        ("person_avidity", f"""
            SELECT person_id, avidity_score,
                   CASE WHEN avidity_score >= {p.tier_avid} THEN 'Avid'
                        WHEN avidity_score >= {p.tier_intermediate} THEN 'Intermediate'
                        WHEN avidity_score >= {p.tier_casual} THEN 'Casual'
                        ELSE 'Non-Fan' END AS tier
            FROM (SELECT f.person_id, CAST(sum(w.weight) AS BIGINT) AS avidity_score
                  FROM region_like_facts f JOIN avidity_weights w ON f.like_id = w.like_id
                  GROUP BY f.person_id)"""),
        ("tier_implications", f"""
            SELECT x.tier, x.like_id, t.name, t.type,
                   x.share_sum / pow(CAST(x.n_likers AS DOUBLE), {exp}) AS score, x.n_likers
            FROM (SELECT a.tier, b.like_id, sum(s.share) AS share_sum, count(*) AS n_likers
                  FROM big_like_facts b
                  JOIN person_avidity a ON b.person_id = a.person_id
                  JOIN person_topic_share s ON b.person_id = s.person_id
                  WHERE a.tier <> 'Non-Fan'
                  GROUP BY a.tier, b.like_id) x
            JOIN topic_and_big_likes t ON x.like_id = t.like_id"""),
    ]


def _final_selects(p: AffinityParams, categories: dict[str, list[str]], slice_names: list[str]) -> dict[str, str]:
    r = RANK_DECIMALS
    impl = f"SELECT like_id, name, type, round(score, {r}) AS score, n_likers FROM "
    top = f" ORDER BY round(score, {r}) DESC, like_id LIMIT {p.report_top}"
    names = sorted({n.lower() for n in slice_names})
    g = "gender_report"
    out = {
        "like_facts": "SELECT fact_id, person_id, like_id FROM like_facts",
        "entities": "SELECT like_id, name, type FROM entities",
        "discover_entities": "SELECT like_id, name, type FROM discover_entities",
        "topic_entities": "SELECT like_id, name, type FROM topic_entities",
        "region_people": "SELECT person_id, country FROM region_people",
        "region_people_states": "SELECT person_id, state FROM region_people_states",
        "region_like_facts": "SELECT fact_id, person_id, like_id FROM region_like_facts",
        "person_total_counts": "SELECT person_id, n_likes FROM person_total_counts",
        "big_likes": "SELECT like_id FROM big_likes",
        "topic_and_big_likes": "SELECT like_id, name, type FROM topic_and_big_likes",
        "person_relevant_counts": "SELECT person_id, n_relevant FROM person_relevant_counts",
        "topic_like_facts": "SELECT like_id, person_id FROM topic_like_facts",
        "person_topic_counts": "SELECT person_id, n_topic FROM person_topic_counts",
        "person_topic_share": f"SELECT person_id, round(share, {r}) AS share FROM person_topic_share",
        "big_like_facts": "SELECT person_id, like_id FROM big_like_facts",
        "like_topic_fractions": f"SELECT like_id, person_id, round(share, {r}) AS share FROM like_topic_fractions",
        "like_topic_sum": f"SELECT like_id, round(share_sum, {r}) AS share_sum FROM like_topic_stats",
        "like_topic_count": "SELECT like_id, n_likers FROM like_topic_stats",
        "entity_implications": impl + "entity_implications",
        "top_implications": impl + "entity_implications" + top,
        "reported_top_implications": impl + "entity_implications" + top,
        "offtopic_implications": impl + "offtopic_implications",
        "top_offtopic": impl + "offtopic_implications" + top,
        "edge_likers": "SELECT person_id FROM edge_likers",
        "edge_nonfans": "SELECT person_id FROM edge_nonfans",
        "region_profiles": ("SELECT person_id, birthday_raw, relationship_raw, gender_raw, locale_raw "
                            "FROM region_profiles"),
        "people_birthdays": "SELECT person_id, birthday FROM people_birthdays",
        "people_ages": "SELECT person_id, age FROM people_ages",
        "people_agebands": "SELECT person_id, ageband FROM people_agebands",
        "people_genders": "SELECT person_id, gender FROM people_genders",
        "people_relationships": "SELECT person_id, relationship FROM people_relationships",
        "people_locales": "SELECT person_id, locale FROM people_locales",
        "person_counts_by_factor": f"SELECT gender, population FROM {g} WHERE population > 0",
        "fan_counts_by_factor": f"SELECT gender, fans FROM {g} WHERE fans > 0",
        "edge_counts_by_factor": f"SELECT gender, edge FROM {g} WHERE edge > 0",
        "fan_like_counts_by_factor": f"SELECT gender, fan_likes FROM {g} WHERE fans > 0",
        "mean_fan_likes_by_factor": f"SELECT gender, round(mean_fan_likes, {r}) AS mean_fan_likes FROM {g} WHERE fans > 0",
        "fan_concentration_by_factor": (f"SELECT gender, round(fan_concentration, {r}) AS fan_concentration "
                                        f"FROM {g} WHERE fans > 0"),
        "edge_concentration_by_factor": (f"SELECT gender, round(edge_concentration, {r}) AS edge_concentration "
                                         f"FROM {g} WHERE edge > 0"),
        "fandom_by_factor": (f"SELECT gender, round(fandom_sum, {r}) AS fandom_sum, round(fandom, {r}) AS fandom "
                             f"FROM {g} WHERE fans > 0 AND n_with_share > 0"),
        **{"factor_report" if attr == "gender" else f"factor_report_{attr}": (
            f"SELECT {attr}, population, fans, fan_likes, edge, round(fandom_sum, {r}) AS fandom_sum, "
            f"round(mean_fan_likes, {r}) AS mean_fan_likes, round(fan_concentration, {r}) AS fan_concentration, "
            f"round(edge_concentration, {r}) AS edge_concentration, round(fandom, {r}) AS fandom "
            f"FROM {attr}_report") for attr in FACTOR_PEOPLE},
        "implications_names": impl + f"entity_implications WHERE lower(name) IN {_in_list(names)}",
        "topic_popularity": "SELECT like_id, n_likers FROM topic_popularity",
        "entity_avidity": "SELECT like_id, name, type, avidity FROM entity_avidity",
        "person_avidity": "SELECT person_id, avidity_score, tier FROM person_avidity",
        "tier_implications": (f"SELECT tier, like_id, name, type, round(score, {r}) AS score, n_likers "
                              "FROM tier_implications"),
        "top_tier_implications": (
            f"SELECT tier, like_id, name, type, round(score, {r}) AS score, n_likers FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY tier ORDER BY round(score, {r}) DESC, like_id) AS rn "
            f"FROM tier_implications) WHERE rn <= {p.report_top}"),
        "estimated_fans_by_age": (f"SELECT age, fans, population, round(estimate, {r}) AS estimate "
                                  "FROM estimated_fans_by_age"),
    }
    for group, types in categories.items():
        out[f"implications_category_{group}"] = impl + f"entity_implications WHERE type IN {_in_list(types)}"
    return out


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_lit(v) for v in values) + "]"


def _variant_ctes(variant: str) -> dict[str, str]:
    """CTEs that differ from the plain ones in a variant of the inputs."""
    if variant == "curated":
        return {"topic_entities": f"""
            SELECT DISTINCT * FROM (
              SELECT like_id, name, type FROM discover_entities
              UNION ALL SELECT like_id, name, type FROM dim_like WHERE starts_with(lower(name), {_lit(FIXTURE_PARAMS.token_a)})
              UNION ALL SELECT like_id, name || ' again', type FROM discover_entities WHERE like_id % 3 = 1
              UNION ALL SELECT -1, 'nobody', 'none' UNION ALL SELECT -2, 'nobody', 'none')"""}
    plain = "SELECT p_partkey AS like_id, p_name AS name, p_type AS type FROM part"
    if variant == "multirow":
        return {"dim_like": f"{plain} UNION ALL SELECT p_partkey, p_name || ' II', 'SECOND' FROM part "
                            "WHERE p_partkey % 4 = 0",
                "topic_entities": "SELECT like_id, name, type FROM discover_entities WHERE type <> 'SECOND'"}
    if variant == "vocabulary":
        types, names = default_types(), vocab.SLICE_NAMES
        first = _ctes_by_name()["discover_entities"].replace("FROM dim_like", f"FROM ({plain})")
        return {"dim_like": f"""
            SELECT p_partkey AS like_id,
                   CASE WHEN p_partkey % 5 = 0 THEN {_list(names)}[p_partkey % {len(names)} + 1] ELSE p_name END AS name,
                   {_list(types)}[p_partkey % {len(types)} + 1] AS type FROM part""",
                "topic_entities": first}
    return {}


def _ctes_by_name() -> dict[str, str]:
    return dict(_ctes(FIXTURE_PARAMS))


def oracle_sql(p: AffinityParams) -> dict[str, str]:
    out = {}
    for variant in VARIANTS:
        default = variant == "vocabulary"
        selects = _final_selects(p, vocab.CATEGORY_GROUPS if default else FIXTURE_CATEGORIES,
                                 vocab.SLICE_NAMES if default else FIXTURE_NAMES)
        changed = _variant_ctes(variant)
        with_clause = "WITH " + ",\n".join(f"{name} AS ({changed.get(name, body)}\n)" for name, body in _ctes(p))
        for name, (of, result) in registry().items():
            if of == variant:
                out[name] = f"{with_clause}\n{selects[result]}"
    return out
