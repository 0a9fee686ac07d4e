"""The registered queries as plain SQL over the given tables, for comparison.

``VIEWS`` states the demo mapping and shared intermediate results; a query's SQL
is the views it needs followed by its own SELECT.
"""

from __future__ import annotations

import re

_W = r"[\p{L}\p{N}_]"
_IMAGE_LIST = "['claim_image','evidence_image','graph_claim','graph_evidence_text','graph_evidence_vis','evidence_image1']"
CLASS = """CASE WHEN suspect AND party IS NOT NULL THEN 'Suspect politician' WHEN suspect THEN 'Suspect'
 WHEN party IS NOT NULL THEN 'Politician' ELSE 'Normal' END"""
SERIES = """count({x}) FILTER (WHERE NOT suspect AND party IS NULL) AS "Normal",
 count({x}) FILTER (WHERE suspect AND party IS NULL) AS "Usual suspect",
 count({x}) FILTER (WHERE NOT suspect AND party IS NOT NULL) AS "Politician",
 count({x}) FILTER (WHERE suspect AND party IS NOT NULL) AS "Usual suspect politician" """

# Order matters: later views use earlier ones, and some use themselves.
VIEWS: dict[str, str] = {
    "ev": """SELECT event_id, ts, user_id, event_type, value,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events""",
    "kinds": """SELECT *, CASE event_type WHEN 'click' THEN 'retweeted' WHEN 'purchase' THEN 'quoted'
        WHEN 'signup' THEN 'replied_to' END AS kind,
        CASE WHEN event_type IN ('click','purchase','signup') THEN event_id - 1 - k END AS parent FROM ev""",
    "received": """SELECT parent, count(*) AS n, count(*) FILTER (WHERE kind='replied_to') AS replies,
        count(*) FILTER (WHERE kind='quoted') AS quotes FROM kinds WHERE parent IS NOT NULL GROUP BY parent""",
    "posts": """SELECT CAST(e.event_id AS VARCHAR) AS id, e.event_id, e.ts AS created_at, e.kind, e.k, e.event_type,
        CAST(e.user_id AS VARCHAR) AS author_id, 'u' || e.user_id AS username,
        e.user_id % 5 = 0 AS suspect,
        CASE e.user_id % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS party,
        coalesce(r.n, 0) AS retweet_count, coalesce(r.replies, 0) AS reply_count,
        CAST(floor(e.value) AS BIGINT) AS like_count, coalesce(r.quotes, 0) AS quote_count,
        'post ' || e.event_id || ' #t' || (e.k % 10) || ' about #' || e.event_type AS text,
        't' || (e.k % 10) AS tag1, 'e' || e.event_type AS tag2, e.kind IS NULL AS is_original, e.parent
        FROM kinds e LEFT JOIN received r ON r.parent = e.event_id""",
    "tags": "SELECT *, tag1 AS tag FROM posts UNION ALL SELECT *, tag2 AS tag FROM posts",
    "refs": """SELECT p.id AS post_id, p.author_id, p.username, p.created_at, p.tag1, p.tag2, q.id AS ref_id, p.kind AS ref_type,
        q.author_id AS ref_author_id, q.username AS ref_username, q.created_at AS ref_created_at, q.is_original AS ref_original
        FROM posts p JOIN posts q ON q.event_id = p.parent""",
    "pairs": """SELECT ref_author_id AS source, author_id AS target, count(*) AS weight FROM refs
        WHERE author_id <> ref_author_id GROUP BY ALL""",
    "edges": """SELECT source, target, weight, 1.0 / weight AS weight_inv,
        CAST(weight AS DOUBLE) / sum(weight) OVER (PARTITION BY source) AS weight_norm FROM pairs""",
    "links": "SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges",
    "degree": """SELECT a AS author_id, CAST(count(*) AS BIGINT) AS degree, CAST(sum(i) AS BIGINT) AS in_degree,
        CAST(sum(o) AS BIGINT) AS out_degree
        FROM (SELECT source AS a, 0 AS i, 1 AS o FROM edges UNION ALL SELECT target, 1, 0 FROM edges) GROUP BY a""",
    "alphas": "SELECT e.*, pow(1 - e.weight_norm, d.degree - 1) AS alpha FROM edges e JOIN degree d ON d.author_id = e.source",
    "roster": "SELECT DISTINCT author_id, username FROM posts",
    "legit": """SELECT r.author_id, count(f.post_id) AS legitimacy FROM roster r
        LEFT JOIN refs f ON f.ref_author_id = r.author_id GROUP BY r.author_id""",
    "periods": "SELECT DISTINCT CAST(date_trunc('day', created_at) AS TIMESTAMP) AS period FROM refs",
    "by_period": """SELECT ref_author_id AS author_id, CAST(date_trunc('day', created_at) AS TIMESTAMP) AS period,
        count(*) AS legitimacy FROM refs GROUP BY ALL""",
    "reput": """SELECT r.author_id, p.period, CAST(sum(coalesce(b.legitimacy, 0))
        OVER (PARTITION BY r.author_id ORDER BY p.period) AS BIGINT) AS reputation
        FROM roster r CROSS JOIN periods p LEFT JOIN by_period b ON b.author_id = r.author_id AND b.period = p.period""",
    "stat": "SELECT author_id, period, rank() OVER (PARTITION BY period ORDER BY reputation) - 1 AS status FROM reput",
    "means": """SELECT l.author_id, l.legitimacy, a.average_reputation, s.average_status FROM legit l
        JOIN (SELECT author_id, avg(reputation) AS average_reputation FROM reput GROUP BY 1) a USING (author_id)
        JOIN (SELECT author_id, avg(status) AS average_status FROM stat GROUP BY 1) s USING (author_id)""",
    "long_means": """SELECT author_id, 'l' AS m, CAST(nullif(legitimacy, 0) AS DOUBLE) AS v FROM means
        UNION ALL SELECT author_id, 'r', nullif(average_reputation, 0) FROM means
        UNION ALL SELECT author_id, 's', nullif(average_status, 0) FROM means""",
    "cuts": """SELECT m, list_sort(list_distinct([min(v), quantile_cont(v, 0.333333333332333), quantile_cont(v, 0.666666666664667),
        max(v)])) AS b FROM long_means WHERE v IS NOT NULL GROUP BY m""",
    "leveled": """SELECT author_id, m, CASE WHEN v IS NULL THEN 'Null'
        WHEN len(b) = 4 THEN CASE WHEN v <= b[2] THEN 'Low' WHEN v <= b[3] THEN 'Medium' ELSE 'High' END
        WHEN len(b) = 3 THEN CASE WHEN v <= b[2] THEN 'Low' ELSE 'High' END ELSE 'Low' END AS level
        FROM long_means LEFT JOIN cuts USING (m)""",
    "standing": """SELECT means.*, a.level AS legitimacy_level, b.level AS reputation_level, c.level AS status_level FROM means
        JOIN leveled a ON a.author_id = means.author_id AND a.m = 'l'
        JOIN leveled b ON b.author_id = means.author_id AND b.m = 'r'
        JOIN leveled c ON c.author_id = means.author_id AND c.m = 's'""",
    "people": f"""SELECT p.author_id, min(p.username) AS username, bool_or(p.suspect) AS suspect, min(p.party) AS party
        FROM posts p GROUP BY p.author_id""",
    "meta": f"""SELECT p.author_id, p.username, p.suspect AS is_usual_suspect, p.party, s.legitimacy, s.average_reputation,
        s.average_status, s.legitimacy_level, s.reputation_level, s.status_level, {CLASS} AS user_type
        FROM people p LEFT JOIN standing s ON s.author_id = p.author_id""",
    "roots": """SELECT id AS cascade_id, created_at, author_id, username FROM posts
        WHERE is_original AND id IN (SELECT ref_id FROM refs)""",
    "sizes": """SELECT p.id AS cascade_id, p.suspect, p.party, count(*) AS size FROM posts p
        JOIN refs r ON r.ref_id = p.id WHERE p.is_original GROUP BY ALL""",
    "ccdf": f"""SELECT user_type, size, 100.0 * sum(n) OVER (PARTITION BY user_type ORDER BY size DESC)
        / sum(n) OVER (PARTITION BY user_type) AS share
        FROM (SELECT {CLASS} AS user_type, size, count(*) AS n FROM sizes GROUP BY ALL)""",
    "steps": "SELECT post_id, ref_id, ref_original FROM refs WHERE author_id <> ref_author_id",
    "belongs": """SELECT ref_id AS cascade_id, post_id FROM steps WHERE ref_original
        UNION SELECT b.cascade_id, s.post_id FROM belongs b JOIN steps s ON s.ref_id = b.post_id""",
    "crefs": """SELECT b.cascade_id, r.ref_id AS source, r.post_id AS target, r.ref_author_id AS source_author_id,
        r.ref_username AS source_username, r.author_id AS target_author_id, r.username AS target_username, r.ref_type AS type,
        r.ref_created_at AS source_created_at, r.created_at AS target_created_at
        FROM belongs b JOIN refs r ON r.post_id = b.post_id WHERE r.author_id <> r.ref_author_id""",
    "nodes": """SELECT cascade_id, cascade_id AS post_id, author_id, username, created_at, 'original' AS type FROM roots
        UNION ALL SELECT cascade_id, target, target_author_id, target_username, target_created_at, type FROM crefs""",
    "spread": """SELECT cascade_id, parent, child FROM (
        SELECT n.cascade_id, u.post_id AS parent, n.post_id AS child,
          row_number() OVER (PARTITION BY n.cascade_id, n.post_id ORDER BY u.created_at DESC, u.post_id DESC) AS rn
        FROM nodes n JOIN edges e ON e.target = n.author_id
        JOIN nodes u ON u.cascade_id = n.cascade_id AND u.author_id = e.source AND u.created_at < n.created_at
        WHERE n.type IN ('retweeted', 'quoted')) WHERE rn = 1""",
    "grown": """SELECT cascade_id, source AS parent, target AS child FROM crefs WHERE type = 'replied_to'
        UNION ALL SELECT cascade_id, parent, child FROM spread""",
    "tree": """SELECT * FROM grown UNION ALL SELECT n.cascade_id, n.cascade_id, n.post_id FROM nodes n
        WHERE n.post_id <> n.cascade_id AND NOT EXISTS
        (SELECT 1 FROM grown g WHERE g.cascade_id = n.cascade_id AND g.child = n.post_id)""",
    "depths": """SELECT cascade_id, cascade_id AS post_id, 0 AS depth FROM roots
        UNION ALL SELECT t.cascade_id, t.child, d.depth + 1 FROM depths d
        JOIN tree t ON t.cascade_id = d.cascade_id AND t.parent = d.post_id""",
    "above": """SELECT cascade_id, post_id, post_id AS anc FROM depths
        UNION ALL SELECT a.cascade_id, a.post_id, t.parent FROM above a
        JOIN tree t ON t.cascade_id = a.cascade_id AND t.child = a.anc""",
    "near": """SELECT a.cascade_id, a.post_id AS p, b.post_id AS q, max(d.depth) AS meet FROM above a
        JOIN above b ON a.cascade_id = b.cascade_id AND a.anc = b.anc
        JOIN depths d ON d.cascade_id = a.cascade_id AND d.post_id = a.anc GROUP BY ALL""",
    "apart": """SELECT x.cascade_id, greatest(m.created_at, n.created_at) AS created_at, sum(c.depth + d.depth - 2 * x.meet) AS dist
        FROM near x JOIN nodes m ON m.cascade_id = x.cascade_id AND m.post_id = x.p
        JOIN nodes n ON n.cascade_id = x.cascade_id AND n.post_id = x.q
        JOIN depths c ON c.cascade_id = x.cascade_id AND c.post_id = x.p
        JOIN depths d ON d.cascade_id = x.cascade_id AND d.post_id = x.q GROUP BY ALL""",
    "placed": """SELECT n.cascade_id, n.created_at, d.depth, n.post_id FROM nodes n JOIN depths d USING (cascade_id, post_id)""",
    "wide": """SELECT cascade_id, created_at, count(*) OVER (PARTITION BY cascade_id, depth ORDER BY created_at) AS w FROM placed""",
    "curves": """SELECT cascade_id, created_at, size, depth, max_breadth, dist / (size * size) AS virality FROM (
        SELECT p.cascade_id, p.created_at, count(*) OVER o AS size, max(p.depth) OVER o AS depth,
          max(w.w) OVER o AS max_breadth, CAST(sum(a.dist) OVER o AS DOUBLE) AS dist
        FROM placed p JOIN wide w USING (cascade_id, created_at) JOIN apart a USING (cascade_id, created_at)
        WINDOW o AS (PARTITION BY p.cascade_id ORDER BY p.created_at))""",
    "scores": """SELECT d.doc_id AS id, CAST(d.doc_id AS VARCHAR) AS id_str, e.ts, e.k / 101.0 AS Miedo,
        (d.n_chars % 1000) / 1009.0 AS Disgusto, e.k / 211.0 + 0.1 AS Sorpresa, (d.n_chars % 1000) / 2003.0 + 0.05 AS Odio,
        1 - e.k / 101.0 AS Diversion, (d.n_chars % 1000) / 4001.0 + e.k / 401.0 AS Agresividad,
        e.k * (d.n_chars % 1000) / 100003.0 AS Dirigido, (d.n_chars % 1000) / 1511.0 AS Enfado, e.k / 151.0 AS Tristeza,
        CAST(l.toxic AS DOUBLE) AS Toxico, 1 - (d.n_chars % 1000) / 1009.0 AS Ironia, CAST(1 - l.quality AS DOUBLE) AS fakeness,
        d.lang AS language
        FROM documents d JOIN ev e ON e.event_id = d.doc_id
        LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id""",
    "profs": """SELECT CAST(c_custkey AS VARCHAR) AS user_id, 'anon ' || c_custkey AS name,
        'I am ' || c_name || ' from the segment ' || c_mktsegment || ' and nation number ' || c_nationkey AS summary,
        c_acctbal > 5000 AS is_verified, CAST(floor(abs(c_acctbal)) AS DOUBLE) AS followers_count,
        CAST(c_nationkey * 10 AS DOUBLE) AS friends_count, CAST(c_custkey % 17 AS DOUBLE) AS listed_count,
        CAST(floor(abs(c_acctbal) / 3) AS DOUBLE) AS favorites_count, (c_custkey % 13) / 13.0 AS stealing_empath,
        (c_nationkey % 5) / 5.0 AS politics_empath, (c_custkey % 11) / 11.0 AS week_days_count_ratio_behav,
        1 - (c_custkey % 11) / 11.0 AS weekend_days_count_ratio_behav,
        CASE WHEN c_nationkey % 2 = 0 THEN 'en' ELSE 'es' END AS lang,
        CASE WHEN c_mktsegment = 'BUILDING' THEN 'male' WHEN c_mktsegment = 'MACHINERY' THEN 'organization' ELSE 'female' END AS gender_demo,
        CASE WHEN c_nationkey < 6 THEN '<=18' WHEN c_nationkey < 12 THEN '19-29' WHEN c_nationkey < 18 THEN '30-39' ELSE '>=40' END AS age_demo
        FROM customer""",
    "grouped": """SELECT *, CASE gender_demo WHEN 'female' THEN 'fake_spreaders' WHEN 'organization' THEN 'fact_checkers'
        ELSE 'control' END AS grp FROM profs""",
    "feats": """UNPIVOT (SELECT user_id, grp, followers_count, friends_count, listed_count, favorites_count,
          CAST(stealing_empath AS DOUBLE) AS stealing_empath, CAST(politics_empath AS DOUBLE) AS politics_empath,
          CAST(week_days_count_ratio_behav AS DOUBLE) AS week_days_count_ratio_behav,
          CAST(weekend_days_count_ratio_behav AS DOUBLE) AS weekend_days_count_ratio_behav FROM grouped)
        ON followers_count, friends_count, listed_count, favorites_count, stealing_empath, politics_empath,
          week_days_count_ratio_behav, weekend_days_count_ratio_behav INTO NAME feature VALUE value""",
    "meds": "SELECT grp, feature, quantile_cont(value, 0.5) AS median FROM feats GROUP BY ALL",
    "checks": """SELECT b.item_id, CAST(b.item_id AS VARCHAR) AS tweet_id, b.text AS claim_text, p.url, e.value
        FROM benchmark b JOIN ev e ON e.event_id = b.item_id LEFT JOIN pages p ON p.page_id = b.item_id""",
    "board": """SELECT p.id AS "ID", p.username AS "User", p.text AS "Text", p.retweet_count AS "Retweets",
        p.suspect AS "Is usual suspect", p.party AS "Party", c.tweet_id IS NOT NULL AS "Multimodal",
        f.user_id IS NOT NULL AS "Profiling", s.fakeness AS "Suspicious content", t.legitimacy_level AS "Legitimacy",
        t.reputation_level AS "Reputation", t.status_level AS "Status", p.author_id AS "Author ID",
        't' || (p.k % 10) || ',' || p.event_type AS hashtags, p.created_at
        FROM posts p LEFT JOIN checks c ON c.tweet_id = p.id LEFT JOIN profs f ON f.user_id = p.author_id
        LEFT JOIN scores s ON s.id_str = p.id LEFT JOIN standing t ON t.author_id = p.author_id WHERE p.is_original""",
    "imgs": f"""SELECT DISTINCT CAST(conv_id AS VARCHAR) AS id, {_IMAGE_LIST}[turn % 6 + 1] AS stem FROM conversations""",
    "turns": "SELECT conv_id, count(*) AS n, max(turn) AS last FROM conversations GROUP BY conv_id",
    "claims": f"""SELECT conv_id, conv_id + 1000 AS tweet_id, list_sort({_IMAGE_LIST}[1:conv_id % 6 + 1]) AS expected FROM turns""",
    "matched": """SELECT c.*, i.found FROM claims c LEFT JOIN
        (SELECT id, list_sort(list(stem)) AS found FROM imgs GROUP BY id) i ON i.id = CAST(c.conv_id AS VARCHAR)""",
    "eligible": """SELECT cascade_id, author_id AS original_author FROM roots
        WHERE author_id IN (SELECT user_id FROM profs) AND cascade_id IN (SELECT id_str FROM scores)""",
    "positives": """SELECT x.author_id AS source, y.author_id AS target, b.cascade_id, b.original_author FROM
        (SELECT cascade_id, parent AS a, child AS b FROM tree UNION SELECT cascade_id, child, parent FROM tree) t
        JOIN eligible b USING (cascade_id) JOIN nodes x ON x.cascade_id = t.cascade_id AND x.post_id = t.a
        JOIN nodes y ON y.cascade_id = t.cascade_id AND y.post_id = t.b""",
    "firsts": """SELECT source, min(cascade_id) AS cascade_id, arg_min(original_author, cascade_id) AS original_author
        FROM positives GROUP BY source HAVING count(*) > 1""",
    "negatives": """SELECT l.a AS source, l.b AS target, f.cascade_id, f.original_author FROM links l JOIN firsts f ON f.source = l.a
        WHERE NOT EXISTS (SELECT 1 FROM positives p WHERE p.source = l.a AND p.target = l.b)""",
    "users": """SELECT r.author_id, p.suspect AS is_usual_suspect, f.lang, f.is_verified, f.followers_count, f.friends_count,
        f.listed_count, f.favorites_count, f.stealing_empath, f.politics_empath, f.week_days_count_ratio_behav,
        f.weekend_days_count_ratio_behav, f.gender_demo, f.age_demo, m.legitimacy, m.average_reputation AS reputation,
        m.average_status AS status
        FROM roster r JOIN people p ON p.author_id = r.author_id LEFT JOIN profs f ON f.user_id = r.author_id
        LEFT JOIN means m ON m.author_id = r.author_id""",
    "largest": """SELECT cascade_id, original_author FROM eligible JOIN (SELECT cascade_id, count(*) AS n FROM nodes GROUP BY cascade_id)
        USING (cascade_id) ORDER BY n DESC, cascade_id LIMIT 1""",
    "observed": "SELECT DISTINCT cascade_id, n.author_id FROM nodes n JOIN largest USING (cascade_id) WHERE n.author_id IS NOT NULL",
    "reached": """SELECT cascade_id, original_author AS author_id FROM largest
        UNION SELECT r.cascade_id, l.b FROM reached r JOIN links l ON l.a = r.author_id
        JOIN users u ON u.author_id = l.a JOIN users v ON v.author_id = l.b
        WHERE coalesce(u.friends_count, 0) <= coalesce(v.friends_count, 0) AND l.b NOT IN (SELECT author_id FROM observed)""",
    "grown_authors": """SELECT cascade_id, author_id, true AS ground_truth FROM observed UNION ALL
        SELECT cascade_id, author_id, false FROM reached WHERE author_id NOT IN (SELECT author_id FROM observed)""",
    "docwords": f"""SELECT source AS user_id, unnest(regexp_extract_all(lower(text), '{_W}+')) AS word FROM documents""",
    "gaps": """SELECT author_id, (epoch_us(created_at) - epoch_us(lag(created_at) OVER (PARTITION BY author_id
        ORDER BY created_at, id))) / 1e6 AS gap FROM posts""",
    "walk": """SELECT a AS s, a AS n, 0 AS d FROM links UNION SELECT w.s, l.b, w.d + 1 FROM walk w
        JOIN links l ON l.a = w.n WHERE w.d < 6""",
    "dist": "SELECT s, n, min(d) AS d FROM walk GROUP BY ALL",
    "mates": """SELECT '7' AS n UNION SELECT b FROM links WHERE a = '7' UNION SELECT y.b FROM links x JOIN links y ON y.a = x.b WHERE x.a = '7'""",
    "around": """SELECT source, target, weight, weight_norm FROM edges WHERE source IN (SELECT n FROM mates) AND target IN (SELECT n FROM mates)""",
    "strong": """SELECT e.source, e.target, e.weight FROM around e JOIN (SELECT a, count(*) AS degree FROM
        (SELECT source AS a FROM around UNION ALL SELECT target FROM around) GROUP BY a) d ON d.a = e.source
        WHERE pow(1 - e.weight_norm, d.degree - 1) > 0
        ORDER BY pow(1 - e.weight_norm, d.degree - 1) DESC, e.source, e.target LIMIT 40""",
    "strong_ends": "SELECT source AS n FROM strong UNION SELECT target FROM strong UNION SELECT '7'",
    "strong_reach": """SELECT n, n AS m FROM strong_ends UNION SELECT r.n, CASE WHEN s.source = r.m THEN s.target ELSE s.source END
        FROM strong_reach r JOIN strong s ON s.source = r.m OR s.target = r.m""",
    "spread_label": """SELECT a AS n, a AS label FROM links UNION SELECT l.b, s.label FROM spread_label s
        JOIN links l ON l.a = s.n""",
}


# The same with a second reference in a third of the replies: posts may belong to several cascades, hang on two
# posts, and be known only as something that a member refers to.
TANGLED = {
    "refs": """SELECT p.id AS post_id, p.author_id, p.username, p.created_at, p.tag1, p.tag2, q.id AS ref_id, p.rtype AS ref_type,
        q.author_id AS ref_author_id, q.username AS ref_username, q.created_at AS ref_created_at, q.is_original AS ref_original
        FROM (SELECT *, parent AS target, kind AS rtype FROM posts UNION ALL
              SELECT *, event_id - 1 - (k * 7 + 11) % 100 AS target, 'quoted' AS rtype FROM posts
              WHERE kind = 'replied_to' AND k % 3 = 0 AND event_id - 1 - (k * 7 + 11) % 100 <> parent
              AND parent IN (SELECT event_id FROM posts)) p
        JOIN posts q ON q.event_id = p.target""",
    # A post whose references all go to its own author ends a branch; else all of them count.
    "steps": """SELECT post_id, ref_id, ref_original FROM refs
        WHERE post_id IN (SELECT post_id FROM refs WHERE author_id <> ref_author_id)""",
    "nodes": """SELECT cascade_id, cascade_id AS post_id, author_id, username, created_at, 'original' AS type FROM roots
        UNION ALL SELECT cascade_id, post_id, any_value(author_id), any_value(username), any_value(created_at),
          coalesce(max(type), 'other') FROM (
            SELECT cascade_id, target AS post_id, target_author_id AS author_id, target_username AS username, target_created_at AS created_at, type FROM crefs
            UNION ALL SELECT cascade_id, source, source_author_id, source_username, source_created_at, NULL FROM crefs)
          WHERE post_id <> cascade_id GROUP BY cascade_id, post_id""",
    "grown": """SELECT DISTINCT c.cascade_id, c.source AS parent, c.target AS child FROM crefs c
        JOIN nodes n ON n.cascade_id = c.cascade_id AND n.post_id = c.target AND n.type = 'replied_to'
        UNION ALL SELECT cascade_id, parent, child FROM spread""",
    "loose": """SELECT n.cascade_id, n.post_id, n.created_at FROM nodes n WHERE n.post_id <> n.cascade_id AND NOT EXISTS
        (SELECT 1 FROM grown g WHERE g.cascade_id = n.cascade_id AND g.child = n.post_id)""",
    "sides": """SELECT cascade_id, parent AS a, child AS b FROM grown UNION SELECT cascade_id, child, parent FROM grown""",
    "parts": """SELECT cascade_id, post_id AS head, post_id AS at FROM loose
        UNION SELECT p.cascade_id, p.head, s.b FROM parts p JOIN sides s ON s.cascade_id = p.cascade_id AND s.a = p.at""",
    "tree": """SELECT * FROM grown UNION ALL SELECT l.cascade_id, l.cascade_id, l.post_id FROM loose l
        WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.cascade_id = l.cascade_id AND p.head = l.post_id AND p.at = l.cascade_id)
        AND NOT EXISTS (SELECT 1 FROM parts p JOIN loose m ON m.cascade_id = p.cascade_id AND m.post_id = p.at
          WHERE p.cascade_id = l.cascade_id AND p.head = l.post_id AND (m.created_at, m.post_id) < (l.created_at, l.post_id))""",
    "steps_down": """SELECT cascade_id, cascade_id AS post_id, 0 AS depth FROM roots
        UNION SELECT t.cascade_id, t.child, d.depth + 1 FROM steps_down d
        JOIN tree t ON t.cascade_id = d.cascade_id AND t.parent = d.post_id""",
    "depths": """SELECT n.cascade_id, n.post_id, coalesce(min(d.depth), -1) AS depth FROM nodes n
        LEFT JOIN steps_down d USING (cascade_id, post_id) GROUP BY ALL""",
    "ends": """SELECT cascade_id, parent AS a, child AS b FROM tree UNION SELECT cascade_id, child, parent FROM tree""",
    # Walks in either direction, none longer than the posts of the largest cascade allow; the shortest count.
    "walks": """SELECT cascade_id, post_id AS p, post_id AS q, 0 AS len FROM nodes
        UNION SELECT w.cascade_id, w.p, e.b, w.len + 1 FROM walks w JOIN ends e ON e.cascade_id = w.cascade_id AND e.a = w.q
        WHERE w.len < (SELECT 2 * max(depth) + 4 FROM depths)""",
    "apart": """SELECT x.cascade_id, greatest(m.created_at, n.created_at) AS created_at, sum(x.len) AS dist
        FROM (SELECT cascade_id, p, q, min(len) AS len FROM walks GROUP BY ALL) x
        JOIN nodes m ON m.cascade_id = x.cascade_id AND m.post_id = x.p
        JOIN nodes n ON n.cascade_id = x.cascade_id AND n.post_id = x.q GROUP BY ALL""",
}


def _tangled(select: str) -> str:
    """A statement over the views with the second references."""
    order = ["loose", "sides", "parts"], ["steps_down"], ["ends", "walks"]
    names = list(VIEWS)
    for extra, before in zip(order, ("tree", "depths", "apart")):
        names[names.index(before) : names.index(before)] = extra
    views, wanted, todo = VIEWS | TANGLED, set(), [select]
    while todo:
        for name in set(re.findall(r"(?:FROM|JOIN)\s+\(?\s*([a-z_]+)", todo.pop())) & set(views) - wanted:
            wanted.add(name)
            todo.append(views[name])
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({views[n]})" for n in names if n in wanted) + "\n" + select


def _needed(text: str) -> list[str]:
    """Views a statement mentions, directly or through other views, in order."""
    wanted: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"(?:FROM|JOIN)\s+\(?\s*([a-z_]+)", todo.pop()))
        for name in words & set(VIEWS):
            if name not in wanted:
                wanted.add(name)
                todo.append(VIEWS[name])
    return [v for v in VIEWS if v in wanted]


def with_views(select: str) -> str:
    names = _needed(select)
    if not names:
        return select
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + select


def _day(column: str) -> str:
    return f"CAST(date_trunc('day', {column}) AS TIMESTAMP)"


_EMOTIONS = {
    "Miedo": "Fear",
    "Disgusto": "Disgust",
    "Sorpresa": "Surprise",
    "Odio": "Hate",
    "Diversion": "Fun",
    "Agresividad": "Aggressiveness",
    "Dirigido": "Targeted",
    "Enfado": "Anger",
    "Tristeza": "Sadness",
    "Toxico": "Toxic",
    "Ironia": "Irony",
}
_FEATURE_COLS = [
    "is_usual_suspect",
    "lang",
    "is_verified",
    "followers_count",
    "friends_count",
    "listed_count",
    "favorites_count",
    "stealing_empath",
    "politics_empath",
    "week_days_count_ratio_behav",
    "weekend_days_count_ratio_behav",
    "gender_demo",
    "age_demo",
    "legitimacy",
    "reputation",
    "status",
]
_REAL = {
    "stealing_empath",
    "politics_empath",
    "week_days_count_ratio_behav",
    "weekend_days_count_ratio_behav",
    "reputation",
    "status",
}


def _role(alias: str, suffix: str) -> str:
    return ", ".join(
        (f"round({alias}.{c}, 6)" if c in _REAL else f"{alias}.{c}") + f" AS {c}{suffix}" for c in _FEATURE_COLS
    )


_SCORED = ", ".join(
    f'round(s.{c}, 6) AS "{c}"' if c in _EMOTIONS or c == "fakeness" else f's.{c} AS "{c}"'
    for c in ["language", *sorted(_EMOTIONS), "fakeness"]
)
_LABELLED = f"""SELECT x.*, p.reply_count AS num_replies, p.retweet_count AS num_retweets, p.quote_count AS num_quotes,
  p.like_count AS num_likes, {_SCORED}, round(s.fakeness, 6) AS fakeness_probabilities,
  {_role('u', '_prev')}, {_role('v', '_curr')}, {_role('w', '_original')}
 FROM (SELECT source, target, cascade_id, original_author, 1 AS propagated FROM positives
   UNION ALL SELECT source, target, cascade_id, original_author, 0 FROM negatives) x
 JOIN posts p ON p.id = x.cascade_id LEFT JOIN scores s ON s.id_str = x.cascade_id
 JOIN users u ON u.author_id = x.source JOIN users v ON v.author_id = x.target JOIN users w ON w.author_id = x.original_author"""

QUERIES: dict[str, str] = {
    "post_histogram": f"""SELECT {_day('created_at')} AS time, {SERIES.format(x='*')} FROM posts GROUP BY 1""",
    "post_histogram_filtered": f"""SELECT {_day('created_at')} AS time, {SERIES.format(x='*')} FROM posts
        WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-20'
        AND tag1 = 't3' AND tag2 = 'eclick' GROUP BY 1""",
    "author_histogram": f"""SELECT {_day('created_at')} AS time, {SERIES.format(x='DISTINCT username')} FROM posts GROUP BY 1""",
    "histogram_weekly_sunday": f"""SELECT CAST(CAST(created_at AS DATE) - CAST(dayofweek(created_at) AS INTEGER) AS TIMESTAMP) AS time,
        {SERIES.format(x='*')} FROM posts GROUP BY 1""",
    "histogram_three_days": f"""SELECT CAST(DATE '2000-01-01' + CAST(floor(date_diff('day', DATE '2000-01-01',
        CAST(created_at AS DATE)) / 3.0) * 3 AS INTEGER) AS TIMESTAMP) AS time, {SERIES.format(x='*')} FROM posts GROUP BY 1""",
    "hashtag_counts": 'SELECT tag AS hashtag, count(*) AS "count" FROM tags GROUP BY 1',
    "hashtag_counts_author": """SELECT tag AS hashtag, count(*) AS "count" FROM tags WHERE author_id = '7'
        AND created_at >= TIMESTAMP '2024-01-03' AND created_at <= TIMESTAMP '2024-01-27' GROUP BY 1""",
    "hashtag_weights": """SELECT tag AS hashtag, round(CAST(count(*) AS DOUBLE) / max(count(*)) OVER (), 6) AS weight
        FROM tags GROUP BY 1""",
    "top_hashtags": 'SELECT tag AS hashtag, count(*) AS "count" FROM tags GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10',
    "top_profiles": """SELECT username, count(*) AS "count" FROM posts WHERE created_at >= TIMESTAMP '2024-01-02'
        AND created_at <= TIMESTAMP '2024-01-29' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "text_hashtags": f"""SELECT doc_id, nullif(array_to_string(regexp_extract_all(text, '#({_W}+)', 1), ','), '') AS words,
        nullif(array_to_string([x[2:] for x in string_split_regex(text, '\\s+') if starts_with(x, '#')], ','), '') AS tokens
        FROM documents""",
    "dataset_date_range": "SELECT CAST(min(created_at) AS DATE) AS first_day, CAST(max(created_at) AS DATE) AS last_day FROM posts",
    "actor_class_counts": f"""SELECT {CLASS} AS user_type, count(*) AS posts, count(DISTINCT author_id) AS authors FROM posts GROUP BY 1""",
    "annotate_actors": """SELECT p.author_id, s.h IS NOT NULL AS is_usual_suspect, q.party, count(*) AS posts FROM posts p
        LEFT JOIN (SELECT DISTINCT 'u' || s_suppkey AS h FROM supplier WHERE s_nationkey % 2 = 0) s ON s.h = p.username
        LEFT JOIN (SELECT 'u' || c_custkey AS h, coalesce(min(trim(nullif(c_mktsegment, 'MACHINERY'))), 'Desconocido') AS party FROM customer WHERE c_acctbal >= 0 GROUP BY 1) q
        ON q.h = p.username GROUP BY ALL""",
    "cascade_count_over_time": """SELECT CAST(c.d AS TIMESTAMP) AS time, count(r.cascade_id) AS cascades FROM
        (SELECT CAST(unnest(generate_series(min(CAST(created_at AS DATE)), max(CAST(created_at AS DATE)), INTERVAL 1 DAY)) AS DATE) AS d FROM roots) c
        LEFT JOIN roots r ON CAST(r.created_at AS DATE) = c.d GROUP BY 1""",
    "cascade_count_weekly": """SELECT CAST(c.d AS TIMESTAMP) AS time, count(r.cascade_id) AS cascades FROM
        (SELECT CAST(unnest(generate_series(min(w), max(w), INTERVAL 7 DAY)) AS DATE) AS d FROM
         (SELECT CAST(created_at AS DATE) + CAST(7 - isodow(CAST(created_at AS DATE)) AS INTEGER) AS w FROM roots)) c
        LEFT JOIN roots r ON CAST(r.created_at AS DATE) + CAST(7 - isodow(CAST(r.created_at AS DATE)) AS INTEGER) = c.d GROUP BY 1""",
    "board": "SELECT * FROM board",
    "board_by_retweets": """SELECT "ID", "Retweets", "Legitimacy" FROM board ORDER BY "Retweets" DESC, "ID" LIMIT 50""",
    "board_page": """SELECT * EXCLUDE (hashtags, created_at) FROM board ORDER BY "Retweets" DESC, "Legitimacy", "ID" LIMIT 10 OFFSET 20""",
    "board_filtered": """SELECT * EXCLUDE (hashtags, created_at) FROM board WHERE "Retweets" >= 2 AND regexp_matches("Text", 'VIEW', 'i')
        AND strftime(created_at, '%Y-%m-%d') LIKE '2024-01-1%' AND "Profiling" AND "User" <> 'u7'
        AND created_at >= TIMESTAMP '2024-01-02' AND created_at < TIMESTAMP '2024-01-19' AND hashtags LIKE 't3,%'""",
    "board_size": """SELECT count(*) AS size, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages FROM board
        WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-21'""",
    "board_rendered": """SELECT "ID", substr(md5("User"), 1, 8) AS "User", CASE WHEN "Multimodal" THEN 'Yes' ELSE 'No' END AS "Multimodal",
        CASE WHEN "Profiling" THEN 'Yes' ELSE 'No' END AS "Profiling", round("Suspicious content", 2) AS "Suspicious content" FROM board""",
    "average_emotion": " UNION ALL ".join(
        f"SELECT '{n}' AS emotion, round(avg({c}), 6) AS level FROM scores" for c, n in _EMOTIONS.items()
    ),
    "emotion_by_hour": "SELECT CAST(hour(ts) AS INTEGER) AS hour, "
    + ", ".join(f"round(avg({c}), 6) AS \"{n}\"" for c, n in _EMOTIONS.items())
    + " FROM scores WHERE date_trunc('second', ts) >= TIMESTAMP '2024-01-01' AND date_trunc('second', ts) <= TIMESTAMP '2024-01-29' GROUP BY 1",
    "interactions": "SELECT source, target, weight, round(weight_inv, 6) AS weight_inv, round(weight_norm, 6) AS weight_norm FROM edges",
    "interactions_windowed": """SELECT source, target, weight, round(1.0 / weight, 6) AS weight_inv,
        round(CAST(weight AS DOUBLE) / sum(weight) OVER (PARTITION BY source), 6) AS weight_norm FROM (
        SELECT ref_author_id AS source, author_id AS target, count(*) AS weight FROM refs WHERE author_id <> ref_author_id
        AND ref_type IN ('retweeted', 'quoted') AND created_at >= TIMESTAMP '2024-01-04' AND created_at < TIMESTAMP '2024-01-22'
        AND (tag1 IN ('t1', 't2') OR tag2 IN ('t1', 't2')) GROUP BY ALL)""",
    "authors": "SELECT author_id, username FROM roster",
    "network_edges": "SELECT source, target, weight, round(weight_inv, 6) AS weight_inv, round(weight_norm, 6) AS weight_norm FROM edges",
    "network_vertices": "SELECT author_id, username FROM roster",
    "network_windowed": """SELECT source, target, weight, round(weight_norm, 6) AS weight_norm FROM (
        SELECT source, target, weight, CAST(weight AS DOUBLE) / sum(weight) OVER (PARTITION BY source) AS weight_norm FROM (
        SELECT ref_author_id AS source, author_id AS target, count(*) AS weight FROM refs WHERE author_id <> ref_author_id
        AND created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-11' GROUP BY ALL))
        WHERE source IN (SELECT author_id FROM posts WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-11')""",
    "degrees": "SELECT * FROM degree",
    "neighbours": "SELECT DISTINCT b AS author_id FROM links WHERE a = '7' UNION SELECT '7'",
    "ego_depth1": """SELECT source, target, weight FROM edges WHERE source IN (SELECT b FROM links WHERE a = '7' UNION SELECT '7')
        AND target IN (SELECT b FROM links WHERE a = '7' UNION SELECT '7')""",
    "ego_depth2": """SELECT source, target, weight FROM edges
        WHERE source IN (SELECT y.b FROM links x JOIN links y ON y.a = x.b WHERE x.a = '7' UNION SELECT b FROM links WHERE a = '7' UNION SELECT '7')
        AND target IN (SELECT y.b FROM links x JOIN links y ON y.a = x.b WHERE x.a = '7' UNION SELECT b FROM links WHERE a = '7' UNION SELECT '7')""",
    "ego_capped": """SELECT source, target, weight FROM strong UNION ALL
        SELECT '7', arg_min(p.n, ('u' || p.n, p.n)), NULL FROM (SELECT n, min(m) AS part FROM strong_reach GROUP BY n) p
        WHERE p.part <> (SELECT min(m) FROM strong_reach WHERE n = '7') GROUP BY p.part""",
    "backbone": "SELECT source, target, weight, round(alpha, 6) AS alpha FROM alphas WHERE alpha > 0.05",
    "backbone_capped": """SELECT source, target, weight, round(alpha, 6) AS alpha FROM alphas WHERE alpha > 0.05
        ORDER BY alphas.alpha DESC, source, target LIMIT 100""",
    "components": """SELECT r.author_id, coalesce(least(min(s.label), r.author_id), r.author_id) AS component
        FROM roster r LEFT JOIN spread_label s ON s.n = r.author_id GROUP BY r.author_id""",
    "network_size": "SELECT (SELECT count(*) FROM roster) AS num_nodes, (SELECT count(*) FROM edges) AS num_edges",
    "mean_closeness": """SELECT round(avg(c), 6) AS closeness FROM
        (SELECT s, CAST(count(*) - 1 AS DOUBLE) / sum(d) AS c FROM dist GROUP BY s)""",
    "edge_positions": """SELECT e.source, e.target, g.part, CASE g.part WHEN 0 THEN CAST(e.source AS DOUBLE) WHEN 1 THEN CAST(e.target AS DOUBLE) END AS x,
        CASE g.part WHEN 0 THEN CAST(e.source AS BIGINT) % 7 WHEN 1 THEN CAST(e.target AS BIGINT) % 7 END AS y,
        CASE g.part WHEN 0 THEN CAST(e.source AS BIGINT) % 11 WHEN 1 THEN CAST(e.target AS BIGINT) % 11 END AS z
        FROM edges e CROSS JOIN (SELECT unnest([0, 1, 2]) AS part) g""",
    "legitimacy": "SELECT * FROM legit",
    "legitimacy_over_time": "SELECT author_id, period, legitimacy FROM by_period",
    "reputation": "SELECT * FROM reput",
    "status": "SELECT * FROM stat",
    "standing_means": """SELECT author_id, legitimacy, round(average_reputation, 6) AS average_reputation,
        round(average_status, 6) AS average_status FROM means""",
    "standing_levels": "SELECT author_id, legitimacy_level, reputation_level, status_level FROM standing",
    "actor_metadata": """SELECT author_id, username, is_usual_suspect, party, legitimacy, round(average_reputation, 6) AS average_reputation,
        round(average_status, 6) AS average_status, legitimacy_level, reputation_level, status_level, user_type FROM meta""",
    "standing_crosstab": """SELECT user_type, legitimacy_level, reputation_level, status_level, count(*) AS authors FROM meta GROUP BY ALL""",
    "standing_crosstab_marked": """SELECT user_type, legitimacy_level, reputation_level, status_level, count(*) AS authors FROM meta
        WHERE user_type <> 'Normal' GROUP BY ALL""",
    "legitimacy_by_class": "SELECT author_id, user_type, legitimacy FROM meta",
    "legitimacy_trimmed": "SELECT author_id, user_type, legitimacy FROM meta WHERE legitimacy < 1000",
    "legitimacy_distribution": """SELECT 'demo' AS dataset, user_type, unnest([0, 0.25, 0.5, 0.75, 1]::DOUBLE[]) AS share, n,
        round(unnest(q), 6) AS exact, true AS "within" FROM (SELECT user_type, count(legitimacy) AS n,
          quantile_cont(CAST(legitimacy AS DOUBLE), [0, 0.25, 0.5, 0.75, 1]) AS q FROM meta GROUP BY user_type) WHERE n > 0""",
    "cascade_sizes": "SELECT cascade_id, suspect AS is_usual_suspect, party, size FROM sizes",
    "size_ccdf": """SELECT size, max(round(share, 6)) FILTER (WHERE user_type = 'Normal') AS "Normal",
        max(round(share, 6)) FILTER (WHERE user_type = 'Suspect') AS "Suspect",
        max(round(share, 6)) FILTER (WHERE user_type = 'Politician') AS "Politician",
        max(round(share, 6)) FILTER (WHERE user_type = 'Suspect politician') AS "Suspect politician" FROM ccdf GROUP BY size""",
    "size_ccdf_filled": """SELECT user_type, size, round(coalesce(v, lov + (hiv - lov) * (size - los) / (his - los)), 6) AS share FROM (
        SELECT *, last_value(CASE WHEN v IS NOT NULL THEN size END IGNORE NULLS) OVER lo AS los, last_value(v IGNORE NULLS) OVER lo AS lov,
          first_value(CASE WHEN v IS NOT NULL THEN size END IGNORE NULLS) OVER hi AS his, first_value(v IGNORE NULLS) OVER hi AS hiv FROM (
          SELECT e.user_type, g.size, CASE WHEN g.size <= e.f THEN 100.0 WHEN g.size >= e.l THEN 0.0 ELSE c.share END AS v
          FROM (SELECT user_type, min(size) AS f, max(size) AS l FROM ccdf GROUP BY 1 HAVING count(*) > 1) e
          CROSS JOIN (SELECT DISTINCT size FROM ccdf) g LEFT JOIN ccdf c ON c.user_type = e.user_type AND c.size = g.size)
        WINDOW lo AS (PARTITION BY user_type ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          hi AS (PARTITION BY user_type ORDER BY size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    "cascade_roots": "SELECT cascade_id, created_at, author_id FROM roots",
    "cascade_references": "SELECT * FROM crefs",
    "cascade_nodes": "SELECT * FROM nodes",
    "cascade_edges": "SELECT cascade_id, parent, child FROM tree",
    "cascade_depths": "SELECT cascade_id, post_id, depth FROM depths",
    "cascade_curves": "SELECT cascade_id, created_at, size, depth, max_breadth, round(virality, 6) AS virality FROM curves",
    "cascade_node_count": "SELECT cascade_id, count(*) AS size, count(*) > 1 AS has_propagation FROM nodes GROUP BY 1",
    "cascade_lookup": """SELECT cascade_id, created_at, size, depth, max_breadth, round(virality, 6) AS virality FROM curves
        WHERE cascade_id = '100'""",
    "conversation_curves": """SELECT CAST(c.conv_id AS VARCHAR) || '-0' AS cascade_id, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * c.turn AS created_at,
        c.turn + 1 AS size, c.turn AS depth, 1 AS max_breadth,
        round((SELECT CAST(sum(abs(a.turn - b.turn)) AS DOUBLE) FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id
          WHERE a.conv_id = c.conv_id AND a.turn <= c.turn AND b.turn <= c.turn) / ((c.turn + 1) * (c.turn + 1)), 6) AS virality
        FROM conversations c WHERE c.conv_id IN (SELECT conv_id FROM conversations WHERE turn > 0)""",
    "top_cascades": "SELECT id AS cascade_id, retweet_count FROM posts WHERE is_original ORDER BY 2 DESC, 1 LIMIT 20",
    "top_posts_by_class": f"""SELECT * FROM (SELECT 'demo' AS dataset, {CLASS} AS user_type, id, retweet_count,
        CAST(row_number() OVER (PARTITION BY {CLASS} ORDER BY retweet_count DESC, id) AS INTEGER) AS rank FROM posts WHERE is_original) WHERE rank <= 10""",
    "top_authors_by_class": f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_type ORDER BY retweet_count DESC, author_id) AS INTEGER) AS rank FROM (
        SELECT 'demo' AS dataset, {CLASS} AS user_type, author_id, CAST(sum(retweet_count) AS BIGINT) AS retweet_count FROM posts
        WHERE is_original AND retweet_count > 2 GROUP BY ALL)) WHERE rank <= 10""",
    "profile_cards": """SELECT user_id AS twitter_id, name, regexp_replace(summary, '(.{60})(.)', '\\1<br>\\2') AS description,
        CAST(CAST(followers_count AS BIGINT) AS VARCHAR) AS followers, CAST(CAST(friends_count AS BIGINT) AS VARCHAR) AS followed,
        age_demo AS age, CASE gender_demo WHEN 'male' THEN 'Home' WHEN 'female' THEN 'Dona' ELSE 'Organització' END AS gender,
        CASE WHEN is_verified THEN 'Sí' ELSE 'No' END AS verified FROM profs""",
    "group_medians": 'SELECT grp AS "group", feature, round(median, 6) AS median FROM meds',
    "profile_comparison": """SELECT f.user_id AS twitter_id, f.feature, c.display_name, c.rank, c.panel, round(f.value, 6) AS "user",
        round(a.median, 6) AS fake_spreaders, round(b.median, 6) AS fact_checkers, round(d.median, 6) AS control
        FROM feats f JOIN (VALUES ('followers_count', 'followers', 0, 1), ('friends_count', 'followed', 1, 1),
          ('listed_count', 'lists', 2, 2), ('favorites_count', 'favourites', 3, 1)) c(feature, display_name, rank, panel) ON c.feature = f.feature
        LEFT JOIN meds a ON a.feature = f.feature AND a.grp = 'fake_spreaders'
        LEFT JOIN meds b ON b.feature = f.feature AND b.grp = 'fact_checkers'
        LEFT JOIN meds d ON d.feature = f.feature AND d.grp = 'control'""",
    "group_share": """SELECT grp AS "group", age_demo, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY grp), 6) AS share
        FROM grouped GROUP BY grp, age_demo""",
    "behaviour_features": """SELECT p.author_id, round(avg(CASE WHEN dayofweek(created_at) IN (0, 6) THEN 0 ELSE 1 END), 6) AS week_days_count_ratio_behav,
        round(avg(CASE WHEN dayofweek(created_at) IN (0, 6) THEN 1 ELSE 0 END), 6) AS weekend_days_count_ratio_behav,
        round(avg(CASE WHEN hour(created_at) < 8 THEN 1 ELSE 0 END), 6) AS tweets_sleep_time_ratio_behav,
        round(avg(CASE WHEN hour(created_at) < 8 THEN 0 ELSE 1 END), 6) AS tweets_awake_time_ratio_behav,
        round(any_value(g.m), 3) AS median_time_betweet_tweets_behav FROM posts p
        LEFT JOIN (SELECT author_id, quantile_cont(gap, 0.5) AS m FROM gaps GROUP BY 1) g ON g.author_id = p.author_id GROUP BY p.author_id""",
    "social_features": """SELECT p.author_id, round(avg(retweet_count), 6) AS retweets_count_social, round(avg(like_count), 6) AS favs_count_social,
        CAST(0 AS DOUBLE) AS mentions_count_social, round(avg(CASE WHEN r.ref_type = 'quoted' THEN 1 ELSE 0 END), 6) AS ratio_quoted_tweet_types,
        round(avg(CASE WHEN r.ref_type = 'retweeted' THEN 1 ELSE 0 END), 6) AS ratio_retweets_tweet_types,
        round(avg(CASE WHEN r.ref_type = 'replied_to' THEN 1 ELSE 0 END), 6) AS ratio_replies_tweet_types,
        round(avg(CASE WHEN is_original THEN 1 ELSE 0 END), 6) AS ratio_original_tweet_types
        FROM posts p LEFT JOIN refs r ON r.post_id = p.id GROUP BY p.author_id""",
    "lexicon_scores": """SELECT user_id, category, round(CAST(count(DISTINCT pos) AS DOUBLE) / any_value(total), 6) AS score FROM (
        SELECT w.user_id, w.word, row_number() OVER () AS pos, count(*) OVER (PARTITION BY w.user_id) AS total FROM docwords w) w
        JOIN (VALUES ('the', false, 'article'), ('un', true, 'article'), ('la', false, 'article'), ('th', true, 'th'), ('the', true, 'th'),
          ('and', false, 'link'), ('und', false, 'link'), ('qu', true, 'link'), ('nicht', false, 'negation')) l(entry, is_prefix, category)
        ON (NOT l.is_prefix AND w.word = l.entry) OR (l.is_prefix AND starts_with(w.word, l.entry)) GROUP BY user_id, category""",
    "fact_check_view": """SELECT tweet_id, claim_text, 'seen at ' || url AS visual_evidence_text,
        round(value / 130, 3) AS text_evidence_similarity_score, round(value / 170, 3) AS visual_evidence_similarity_score,
        round(value / 230, 3) AS visual_evidence_graph_similarity_score, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS visual_evidence_domain FROM checks""",
    "fact_check_ingest": """SELECT conv_id AS id_in_json, 'Openarms' AS dataset, CAST(tweet_id AS VARCHAR) AS tweet_id FROM matched WHERE found = expected""",
    "fact_check_rejected": """SELECT conv_id AS id_in_json, array_to_string(list_sort([x for x in expected if NOT list_contains(found, x)]), ',') AS missing,
        array_to_string(list_sort([x for x in found if NOT list_contains(expected, x)]), ',') AS unexpected FROM matched WHERE found <> expected""",
    "fact_check_missing_images": f"""SELECT CAST(c.conv_id AS VARCHAR) AS tweet_id, s.stem FROM turns c
        CROSS JOIN (SELECT unnest({_IMAGE_LIST}) AS stem) s WHERE NOT EXISTS
        (SELECT 1 FROM imgs i WHERE i.id = CAST(c.conv_id AS VARCHAR) AND i.stem = s.stem)""",
    "fact_check_validation": f"""SELECT id, part, unexpected, missing FROM (
        SELECT CAST(conv_id AS VARCHAR) AS id, 'fields' AS part, CASE WHEN n % 2 = 0 THEN '' ELSE 'extra' END AS unexpected,
          CASE WHEN n % 2 = 0 THEN '' ELSE 'evidence_text' END AS missing FROM turns
        UNION ALL SELECT CAST(conv_id AS VARCHAR), 'results', '', CASE WHEN n % 3 = 0 THEN 'explanations' ELSE '' END FROM turns
        UNION ALL SELECT id, 'images', array_to_string(list_sort([x for x in found if x = 'evidence_image1']), ','),
          array_to_string(list_sort([x for x in ['claim_image','evidence_image','graph_claim','graph_evidence_text','graph_evidence_vis','visual_evidences']
            if NOT list_contains(found, x)]), ',') FROM (SELECT id, list(stem) AS found FROM imgs GROUP BY id))
        WHERE unexpected <> '' OR missing <> ''""",
    "eligible_cascades": "SELECT cascade_id, original_author FROM eligible",
    "positive_pairs": "SELECT source, target, cascade_id, original_author FROM positives",
    "negative_pairs": "SELECT source, target, cascade_id, original_author FROM negatives",
    "pair_features": f"""SELECT x.source, x.target, x.cascade_id, x.original_author, p.retweet_count AS num_retweets, round(s.Miedo, 6) AS "Miedo",
        {_role('u', '_prev')}, {_role('v', '_curr')}, {_role('w', '_original')} FROM positives x
        JOIN posts p ON p.id = x.cascade_id LEFT JOIN scores s ON s.id_str = x.cascade_id
        JOIN users u ON u.author_id = x.source JOIN users v ON v.author_id = x.target JOIN users w ON w.author_id = x.original_author""",
    "propagation_dataset": f"SELECT * EXCLUDE (source, target, cascade_id, original_author) FROM ({_LABELLED})",
    "train_test_split": f"""SELECT source, target, cascade_id, original_author,
        CASE WHEN CAST('0x' || substr(md5('42:' || coalesce(source, '') || chr(31) || coalesce(target, '') || chr(31) || coalesce(cascade_id, '')
          || chr(31) || coalesce(original_author, '')), 1, 8) AS BIGINT) / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS part FROM ({_LABELLED})""",
    "sampled_cascades": f"""SELECT 'demo' AS dataset, {CLASS} AS user_type, id, created_at FROM posts WHERE is_original
        QUALIFY row_number() OVER (PARTITION BY {CLASS} ORDER BY md5('demo' || chr(31) || id), id) <= 10""",
    "grow_cascade_by_rule": "SELECT cascade_id, author_id, ground_truth FROM grown_authors",
    "cast_times": """SELECT p.id, p.created_at, r.ref_created_at FROM posts p LEFT JOIN refs r ON r.post_id = p.id""",
    "flatten_pages": """SELECT p.id, p.username, r.ref_id, r.ref_username, r.ref_created_at FROM posts p LEFT JOIN refs r ON r.post_id = p.id""",
    "ingest_outputs": """SELECT 'preprocessed' AS output, id FROM posts UNION ALL SELECT 'mongoimport', id FROM posts
        UNION ALL SELECT 'usual_suspects_and_politicians', id FROM posts WHERE suspect OR party IS NOT NULL
        UNION ALL SELECT 'media', id FROM posts WHERE (k % 10) % 2 = 0""",
    "sample_per_period": f"""SELECT {_day('created_at')} AS period, id FROM posts
        QUALIFY row_number() OVER (PARTITION BY {_day('created_at')} ORDER BY md5(id || '42'), id) <= 10""",
    "rule_confusion_matrix": f"""SELECT propagated AS actual, CAST(coalesce(num_retweets, 0) % 2 AS INTEGER) AS predicted, count(*) AS "rows"
        FROM ({_LABELLED}) GROUP BY ALL""",
    "rule_metrics": f"""SELECT round((c00 + c11) / (c00 + c01 + c10 + c11), 6) AS accuracy,
               round((coalesce(c00 / nullif(c00 + c10, 0), 0) + coalesce(c11 / nullif(c11 + c01, 0), 0)) / 2, 6) AS precision,
               round((coalesce(c00 / nullif(c00 + c01, 0), 0) + coalesce(c11 / nullif(c11 + c10, 0), 0)) / 2, 6) AS recall,
               round((coalesce(2 * c00 / nullif(2 * c00 + c01 + c10, 0), 0) + coalesce(2 * c11 / nullif(2 * c11 + c01 + c10, 0), 0)) / 2, 6) AS f1_score,
               c00 + c01 AS no_propagation_support, c10 + c11 AS propagation_support
        FROM (SELECT count(*) FILTER (a = 0 AND p = 0) AS c00, count(*) FILTER (a = 0 AND p = 1) AS c01,
                     count(*) FILTER (a = 1 AND p = 0) AS c10, count(*) FILTER (a = 1 AND p = 1) AS c11
              FROM (SELECT propagated AS a, CAST(coalesce(num_retweets, 0) % 2 AS INTEGER) AS p FROM ({_LABELLED})))""",
    "feature_modes": " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(v, 6) AS value FROM (SELECT CAST("{c}" AS DOUBLE) AS v, count(*) AS n FROM ({_LABELLED})
        WHERE "{c}" IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1)"""
        for c in ("num_retweets", "propagated", "Miedo")
    ),
}


_TEXT_FEATURES = ["language", *[f"{c}_{role}" for role in ("prev", "curr", "original") for c in ("lang", "gender_demo", "age_demo")]]
_MODEL_FEATURES = [
    "num_replies", "num_retweets", "num_quotes", "num_likes", "language", *sorted(_EMOTIONS), "fakeness", "fakeness_probabilities",
    *[f"{c}_{role}" for role in ("prev", "curr", "original") for c in _FEATURE_COLS],
]
_NUMBERS = [c for c in _MODEL_FEATURES if c not in _TEXT_FEATURES]
_SPLIT_TEST = """CAST('0x' || substr(md5('42:' || coalesce(source, '') || chr(31) || coalesce(target, '') || chr(31) || coalesce(cascade_id, '')
  || chr(31) || coalesce(original_author, '')), 1, 8) AS BIGINT) / 4294967296.0 < 0.2"""


def _long(columns: list[str], kind: str) -> str:
    cast = ", ".join(f'CAST("{c}" AS {kind}) AS "{c}"' for c in columns)
    names = ", ".join(f'"{c}"' for c in columns)
    return f"SELECT id, f, x FROM (SELECT id, {cast} FROM lab) UNPIVOT INCLUDE NULLS (x FOR f IN ({names}))"


def _filled(long: str) -> str:
    return f"""SELECT l.id, l.f, coalesce(l.x, m.x) AS x FROM {long} l JOIN (SELECT f, x FROM
        (SELECT f, x, count(*) AS n FROM {long} WHERE x IS NOT NULL AND id IN (SELECT id FROM lab WHERE learn) GROUP BY f, x)
        QUALIFY row_number() OVER (PARTITION BY f ORDER BY n DESC, x) = 1) m ON m.f = l.f"""


# Rows with a number, whether the model learns from them, and their features: filled, and texts as categories or buckets.
def _encoded(learn: str) -> dict[str, str]:
    return {
        "lab": f"SELECT row_number() OVER () AS id, {learn} AS learn, * FROM ({_LABELLED})",
        "raw_numbers": _long(_NUMBERS, "DOUBLE"),
        "raw_texts": _long(_TEXT_FEATURES, "VARCHAR"),
        "numbers": _filled("raw_numbers"),
        "texts": f"""SELECT t.id, t.f, t.f || CASE WHEN h.x IS NULL THEN '#' || CAST(CAST('0x' || substr(md5(t.x), 1, 8) AS BIGINT) % 32 AS VARCHAR)
            ELSE '=' || t.x END AS slot FROM ({_filled("raw_texts")}) t LEFT JOIN (SELECT f, x FROM raw_texts WHERE x IS NOT NULL AND id IN
            (SELECT id FROM lab WHERE learn) GROUP BY f, x HAVING count(*) * 100 >= (SELECT count(*) FROM lab WHERE learn)) h ON h.f = t.f AND h.x = t.x""",
    }


def _model(learn: str, select: str, rounds: int = 4, depth: int = 6, step: float = 0.3) -> str:
    """A statement over ``scored`` (the rows with ``margin``) and ``splits`` of boosted trees, a view per level."""
    views = _encoded(learn)
    ranks = ", ".join(f"CAST(ceil(n * {k}::DOUBLE / 32) AS BIGINT)" for k in range(1, 32))
    views["cuts"] = f"""SELECT DISTINCT f, x AS cut FROM (SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY x) AS pos, count(*) OVER (PARTITION BY f) AS n
        FROM numbers WHERE id IN (SELECT id FROM lab WHERE learn)) WHERE pos = 1 OR list_contains([{ranks}], pos)"""
    views["bins"] = """SELECT n.id, n.f, d.b FROM numbers n JOIN (SELECT v.f, v.x, count(*) FILTER (c.cut < v.x) AS b
          FROM (SELECT DISTINCT f, x FROM numbers) v JOIN cuts c ON c.f = v.f GROUP BY v.f, v.x) d ON d.f = n.f AND d.x = n.x
        UNION ALL SELECT t.id, s.slot, CAST(t.slot = s.slot AS INTEGER) FROM texts t JOIN (SELECT DISTINCT f, slot FROM texts) s ON s.f = t.f"""
    views["classes"] = """SELECT (count(*) FILTER (propagated = 0))::DOUBLE / (count(*) FILTER (propagated = 1)) AS heavy FROM lab WHERE learn"""
    views["margin0"] = """SELECT id, learn, CAST(propagated AS DOUBLE) AS y, CASE WHEN propagated = 1 THEN heavy ELSE 1 END AS w, 0::DOUBLE AS margin
        FROM lab, classes"""
    gained = []
    for r in range(rounds):
        views[f"level{r}_0"] = f"""SELECT id, learn, 0 AS node, CAST(floor(w * (p - y) * 65536 + 0.5::DOUBLE) AS BIGINT) AS g,
            CAST(floor(w * p * (1 - p) * 65536 + 0.5::DOUBLE) AS BIGINT) AS h FROM (SELECT *, 1 / (1 + exp(-margin)) AS p FROM margin{r})"""
        for d in range(depth):
            views[f"split{r}_{d}"] = f"""SELECT node, f, b, gain FROM (SELECT *, gl * gl / (hl + 1) + gr * gr / (hr + 1) - ga * ga / (ha + 1) AS gain
                FROM (SELECT node, f, b, CAST(gl AS DOUBLE) / 65536 AS gl, CAST(hl AS DOUBLE) / 65536 AS hl, CAST(ga AS DOUBLE) / 65536 AS ga,
                  CAST(ha AS DOUBLE) / 65536 AS ha, CAST(ga - gl AS DOUBLE) / 65536 AS gr, CAST(ha - hl AS DOUBLE) / 65536 AS hr
                  FROM (SELECT node, f, b, sum(g) OVER upto AS gl, sum(h) OVER upto AS hl, sum(g) OVER part AS ga, sum(h) OVER part AS ha
                    FROM (SELECT l.node, e.f, e.b, sum(l.g) AS g, sum(l.h) AS h FROM level{r}_{d} l JOIN bins e ON e.id = l.id WHERE l.learn GROUP BY ALL)
                    WINDOW upto AS (PARTITION BY node, f ORDER BY b), part AS (PARTITION BY node, f))) WHERE hl >= 1 AND hr >= 1) WHERE gain > 0
                QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, b) = 1"""
            views[f"level{r}_{d + 1}"] = f"""SELECT l.id, l.learn, CASE WHEN s.node IS NULL THEN l.node WHEN e.b <= s.b THEN 2 * l.node + 1
                ELSE 2 * l.node + 2 END AS node, l.g, l.h FROM level{r}_{d} l LEFT JOIN split{r}_{d} s ON s.node = l.node
                LEFT JOIN bins e ON e.id = l.id AND e.f = s.f"""
            # A node that is left as it is at one level is the same at the next.
            gained.append(f"SELECT {r} AS tree, node, f, gain FROM split{r}_{d}")
        views[f"margin{r + 1}"] = f"""SELECT m.id, m.learn, m.y, m.w, m.margin + v.value AS margin FROM margin{r} m JOIN level{r}_{depth} l ON l.id = m.id
            JOIN (SELECT node, -(sum(g)::DOUBLE / 65536) / (sum(h)::DOUBLE / 65536 + 1) * {step}::DOUBLE AS value FROM level{r}_{depth}
              WHERE learn GROUP BY node) v ON v.node = l.node"""
    views["splits"] = " UNION ".join(gained)
    views["scored"] = f"SELECT id, learn, CAST(y AS INTEGER) AS actual, CAST(margin > 0 AS INTEGER) AS predicted FROM margin{rounds}"
    return _stacked(views, select)


def _stacked(views: dict[str, str], select: str) -> str:
    base = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _needed(_LABELLED))
    return f"WITH RECURSIVE {base},\n" + ",\n".join(f"{n} AS MATERIALIZED ({v})" for n, v in views.items()) + "\n" + select


_SCORES = """round((c00 + c11) / (c00 + c01 + c10 + c11), 6) AS accuracy,
  round((coalesce(c00 / nullif(c00 + c10, 0), 0) + coalesce(c11 / nullif(c11 + c01, 0), 0)) / 2, 6) AS precision,
  round((coalesce(c00 / nullif(c00 + c01, 0), 0) + coalesce(c11 / nullif(c11 + c10, 0), 0)) / 2, 6) AS recall,
  round((coalesce(2 * c00 / nullif(2 * c00 + c01 + c10, 0), 0) + coalesce(2 * c11 / nullif(2 * c11 + c01 + c10, 0), 0)) / 2, 6) AS f1_score,
  c00 + c01 AS no_propagation_support, c10 + c11 AS propagation_support"""
_CELLS = ", ".join(f"count(*) FILTER (actual = {a} AND predicted = {p}) AS c{a}{p}" for a in (0, 1) for p in (0, 1))


def model_sql() -> dict[str, str]:
    return {
        "encoded_features": _stacked(
            _encoded("true"),
            """, chosen AS MATERIALIZED (SELECT id, f AS feature, x AS value, false AS category FROM numbers
              UNION ALL SELECT id, slot, 1, true FROM texts),
            scales AS (SELECT feature, CASE WHEN category THEN sqrt(n / total * (1 - n / total)) ELSE spread END AS scale FROM
              (SELECT feature, category, count(*)::DOUBLE AS n, stddev_pop(value) AS spread, (SELECT count(*) FROM lab)::DOUBLE AS total
               FROM chosen GROUP BY feature, category))
            SELECT l.source, l.target, l.cascade_id, l.original_author, e.categories, e.n_features, e.total FROM lab l JOIN
              (SELECT c.id, string_agg(c.feature, ',' ORDER BY c.feature) FILTER (c.category) AS categories, count(*) AS n_features,
                round(sum(c.value / CASE WHEN s.scale > 1e-9 THEN s.scale ELSE 1 END), 6) AS total
               FROM chosen c JOIN scales s ON s.feature = c.feature WHERE c.value <> 0 GROUP BY c.id) e ON e.id = l.id""",
        ),
        "propagation_model_metrics": _model(
            f"NOT ({_SPLIT_TEST})",
            f"SELECT {_SCORES}, part FROM (SELECT CASE WHEN learn THEN 'train' ELSE 'test' END AS part, {_CELLS} FROM scored GROUP BY learn)",
        ),
        "confusion_matrix": _model("true", 'SELECT actual, predicted, count(*) AS "rows" FROM scored GROUP BY ALL'),
        "feature_importances": _model(
            "true",
            """SELECT f AS feature, round(mean / sum(mean) OVER (), 6) AS importance FROM (SELECT f, avg(gain) AS mean FROM splits GROUP BY f)
            ORDER BY mean DESC, f LIMIT 20""",
        ),
    }


TANGLED_QUERIES = {
    "tangled_nodes": "SELECT cascade_id, post_id, author_id, type FROM nodes",
    "tangled_edges": "SELECT cascade_id, parent, child FROM tree",
    "tangled_depths": "SELECT cascade_id, post_id, depth FROM depths",
    "tangled_curves": QUERIES["cascade_curves"],
}


def oracle_sql() -> dict[str, str]:
    found = {name: with_views(select) for name, select in QUERIES.items()}
    return found | {name: _tangled(select) for name, select in TANGLED_QUERIES.items()} | model_sql()
