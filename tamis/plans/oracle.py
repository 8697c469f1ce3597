"""DuckDB SQL for the queries of the catalog, built from parts in whole numbers."""

from __future__ import annotations


def tokens() -> str:
    return r"""
toks AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS t
  FROM (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents)),
info AS (SELECT word, CAST(round(-ln(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM toks)) * 1e6) AS BIGINT) AS mn FROM toks GROUP BY word),
tok AS (SELECT doc_id, t, mn FROM toks JOIN info USING (word))"""


def token_loss(j: int, series: str = "perturbation") -> str:
    part = f"{j} * (100 + (doc_id * 7919 + t * 104729) % 97)"
    return f"(mn * ({'1000 + ' if series == 'perturbation' else '2000 - '}{part}) // 1000)"


def trajectories(checkpoints: list[int], most: int = 100, series: str = "perturbation") -> str:
    sums = ", ".join(f"sum({token_loss(j, series)}) AS s{j}" for j in checkpoints)
    means = ", ".join(f"CAST(coalesce(s{j} // n, 0) AS BIGINT) AS f{i}" for i, j in enumerate(checkpoints))
    return f"""{tokens()},
means AS (SELECT doc_id, count(*) AS n, {sums} FROM tok WHERE t <= {most} GROUP BY doc_id),
traj AS (SELECT d.doc_id AS sample_id, lang AS domain, lang || ':' || source AS source, {means} FROM documents d LEFT JOIN means USING (doc_id))"""


def strata(table: str, keys: str, last: str, name: str) -> str:
    return f"{name} AS (SELECT {keys}, count(*) AS size, CAST(sum(f0) AS BIGINT) AS fs, CAST(sum({last}) AS BIGINT) AS ls FROM {table} GROUP BY {keys})"


DIFFICULTY = "sqrt((CAST(ls AS DOUBLE) / CAST(size AS DOUBLE) / 1e6 - CAST(fs AS DOUBLE) / CAST(size AS DOUBLE) / 1e6) * (CAST(ls AS DOUBLE) / CAST(size AS DOUBLE) / 1e6))"


def softmax(tag: str, source: str) -> str:
    """CTE {tag}(grp, name, take) from a relation of grp, name, size, d, budget."""
    return f"""
{tag}_e AS (SELECT grp, name, size, budget, exp(d - max(d) OVER (PARTITION BY grp)) AS e, row_number() OVER (PARTITION BY grp ORDER BY size, name) AS i FROM {source}),
{tag}_p AS (SELECT grp, name, size, budget, i, e / sum(e) OVER (PARTITION BY grp) AS p FROM {tag}_e),
{tag}_t AS (
  SELECT grp, i, p, p AS pl FROM {tag}_p QUALIFY i = max(i) OVER (PARTITION BY grp)
  UNION ALL
  SELECT p.grp, p.i, p.p, t.pl + p.p FROM {tag}_t t JOIN {tag}_p p ON p.grp = t.grp AND p.i = t.i - 1),
{tag}_r AS (
  SELECT grp, 0 AS i, CAST(max(budget) AS BIGINT) AS rest, '' AS name, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS take FROM {tag}_p GROUP BY grp
  UNION ALL
  SELECT grp, i, rest - take, name, size, take FROM (
    SELECT r.grp, p.i, r.rest, p.name, p.size,
      CAST(CASE WHEN p.size < floor(p.p * p.budget) THEN p.size ELSE greatest(least(CASE WHEN t.pl > 0 THEN floor(p.p / t.pl * r.rest) ELSE 0 END, p.size), 0) END AS BIGINT) AS take
    FROM {tag}_r r JOIN {tag}_p p ON p.grp = r.grp AND p.i = r.i + 1 JOIN {tag}_t t ON t.grp = p.grp AND t.i = p.i)),
{tag}_rest AS (SELECT grp, min(rest) AS rest FROM {tag}_r GROUP BY grp),
{tag} AS (SELECT r.grp, r.name, r.size, CAST(take + greatest(0, least(r.size - take, x.rest - coalesce(sum(r.size - take) OVER (PARTITION BY r.grp ORDER BY r.size DESC, r.name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS take
  FROM {tag}_r r JOIN {tag}_rest x USING (grp) WHERE r.i > 0)"""


def hierarchical(tag: str, table: str, last: str, budget: int, per_cluster: int = 4) -> str:
    """CTE {tag}(domain, source, n_clusters, n_samples, n_rows)."""
    return f"""
{strata(table, 'domain', last, tag + '_ds')},
{tag}_di AS (SELECT 'all' AS grp, domain AS name, size, {DIFFICULTY} AS d, {budget} AS budget FROM {tag}_ds),{softmax(tag + '_dom', tag + '_di')},
{strata(table, 'domain, source', last, tag + '_ss')},
{tag}_si AS (SELECT s.domain AS grp, s.source AS name, s.size, {DIFFICULTY.replace('size', 's.size').replace('ls', 's.ls').replace('fs', 's.fs')} AS d, b.take AS budget FROM {tag}_ss s JOIN {tag}_dom b ON b.name = s.domain),{softmax(tag + '_src', tag + '_si')},
{tag} AS (SELECT grp AS domain, name AS source, greatest(1, take // {per_cluster}) AS n_clusters, take AS n_samples, size AS n_rows FROM {tag}_src)"""


def kmeans(tag: str, table: str, features: list[str], niter: int, seed: int = 42) -> str:
    """CTE {tag} from a relation with domain, source, sample_id, k and the features: all its columns, cluster and dist."""
    cols = ", ".join(features)
    parts = [f"{tag}_c0 AS (SELECT domain, source, cluster, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY domain, source ORDER BY md5('{seed}:' || sample_id), sample_id) - 1 AS cluster FROM {table}) WHERE cluster < k)"]
    dist = " + ".join(f"(t.{f} - c.{f}) * (t.{f} - c.{f})" for f in features)
    for i in range(niter + 1):
        name = tag if i == niter else f"{tag}_a{i}"
        parts.append(f"{name} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY dist, cluster) AS rn FROM (SELECT t.*, c.cluster, {dist} AS dist FROM {table} t JOIN {tag}_c{i} c USING (domain, source))) WHERE rn = 1)")
        if i < niter:
            sums = ", ".join(f"CAST(sum({f}) // count(*) AS BIGINT) AS {f}" for f in features)
            kept = ", ".join(f"coalesce(m.{f}, c.{f}) AS {f}" for f in features)
            parts.append(f"{tag}_c{i + 1} AS (SELECT c.domain, c.source, c.cluster, {kept} FROM {tag}_c{i} c LEFT JOIN (SELECT domain, source, cluster, {sums} FROM {name} GROUP BY ALL) m USING (domain, source, cluster))")
    return ",\n".join(parts)


def quota_fold(tag: str, sizes: str, least: int = 2) -> str:
    """CTE {tag}(domain, source, cluster, quota) from a relation of domain, source, cluster, size, n_samples."""
    return f"""
{tag}_o AS (SELECT *, row_number() OVER (PARTITION BY domain, source ORDER BY size, cluster) AS i, count(*) OVER (PARTITION BY domain, source) AS c FROM {sizes} WHERE size >= {least}),
{tag}_r AS (
  SELECT DISTINCT domain, source, CAST(0 AS BIGINT) AS i, CAST(n_samples AS BIGINT) AS rest, CAST(0 AS BIGINT) AS cluster, CAST(0 AS BIGINT) AS quota FROM {tag}_o
  UNION ALL
  SELECT r.domain, r.source, o.i, r.rest - least(o.size, r.rest // (o.c - o.i + 1)), o.cluster, CAST(least(o.size, r.rest // (o.c - o.i + 1)) AS BIGINT)
  FROM {tag}_r r JOIN {tag}_o o ON o.domain = r.domain AND o.source = r.source AND o.i = r.i + 1),
{tag} AS (SELECT domain, source, cluster, quota FROM {tag}_r WHERE i > 0)"""


def learnability(tag: str, clustered: str, last: str, seed: int = 42) -> str:
    """CTE {tag}(domain, source, sample_id) from a clustered relation with n_samples and n_rows."""
    return f"""
{tag}_in AS (SELECT * FROM {clustered} WHERE n_samples < n_rows),
{tag}_sz AS (SELECT domain, source, cluster, count(*) AS size, sum(f0) < sum({last}) AS up, max(n_samples) AS n_samples FROM {tag}_in GROUP BY domain, source, cluster),{quota_fold(tag + '_q', tag + '_sz')},
{tag}_sc AS (SELECT a.*, s.size AS csize, CASE WHEN s.up THEN {last} - f0 ELSE f0 - {last} END AS score FROM {tag}_in a JOIN {tag}_sz s USING (domain, source, cluster)),
{tag}_top AS (SELECT domain, source, sample_id FROM (SELECT s.*, q.quota, row_number() OVER (PARTITION BY s.domain, s.source, s.cluster ORDER BY score DESC, sample_id) AS rn FROM {tag}_sc s JOIN {tag}_q q USING (domain, source, cluster) WHERE csize >= 2) WHERE rn <= quota),
{tag}_left AS (SELECT z.domain, z.source, z.b - coalesce(t.taken, 0) AS rest FROM (SELECT domain, source, max(n_samples) AS b FROM {tag}_sz GROUP BY ALL) z LEFT JOIN (SELECT domain, source, sum(quota) AS taken FROM {tag}_q GROUP BY ALL) t USING (domain, source)),
{tag}_one AS (SELECT domain, source, sample_id FROM (SELECT s.domain, s.source, s.sample_id, l.rest, row_number() OVER (PARTITION BY s.domain, s.source ORDER BY md5('{seed}:' || s.sample_id), s.sample_id) AS rn FROM {tag}_sc s JOIN {tag}_left l USING (domain, source) WHERE csize = 1) WHERE rn <= rest),
{tag} AS (SELECT * FROM {tag}_top UNION ALL SELECT * FROM {tag}_one UNION ALL SELECT domain, source, sample_id FROM {clustered} WHERE n_samples >= n_rows)"""


def softmax_selection(tag: str, table: str, features: list[str], budget: int, niter: int) -> str:
    """CTE {tag}(domain, source, sample_id): hierarchical budgets, clusters, learnability."""
    last = features[-1]
    return f"""{hierarchical(tag + '_b', table, last, budget)},
{tag}_t AS (SELECT t.*, n_samples, n_rows, CASE WHEN n_samples >= n_rows THEN 1 ELSE least(n_clusters, n_rows) END AS k FROM {table} t JOIN {tag}_b b USING (domain, source) WHERE n_samples > 0),
{kmeans(tag + '_k', tag + '_t', features, niter)},{learnability(tag, tag + '_k', last)}"""


def high_loss(tag: str, clustered: str, features: list[str]) -> str:
    """CTE {tag}: the rows of the upper half of each stratum's clusters."""
    total = " + ".join(features)
    return f"""
{tag}_m AS (SELECT domain, source, cluster, CAST(sum({total}) AS DOUBLE) / (count(*) * {len(features)}) AS m FROM {clustered} GROUP BY ALL),
{tag}_k AS (SELECT domain, source, cluster FROM (SELECT *, row_number() OVER (PARTITION BY domain, source ORDER BY m DESC, cluster) AS rn, count(*) OVER (PARTITION BY domain, source) AS c FROM {tag}_m) WHERE rn <= greatest(1, floor(c * 0.5))),
{tag} AS (SELECT a.* FROM {clustered} a JOIN {tag}_k USING (domain, source, cluster))"""


def shares(tag: str, table: str, budget: int) -> str:
    """CTE {tag}(domain, source, n_rows, i, c, whole): strata by size, whole where all up to them fit an equal share of what is left."""
    return f"""{tag}_s AS (SELECT domain, source, count(*) AS n_rows, row_number() OVER (ORDER BY count(*), domain, source) AS i, count(*) OVER () AS c FROM {table} GROUP BY domain, source),
{tag}_r AS (SELECT CAST(0 AS BIGINT) AS i, CAST({budget} AS BIGINT) AS rest UNION ALL SELECT s.i, r.rest - s.n_rows FROM {tag}_r r JOIN {tag}_s s ON s.i = r.i + 1 WHERE s.n_rows <= r.rest // (s.c - s.i + 1)),
{tag} AS (SELECT s.*, s.i <= (SELECT max(i) FROM {tag}_r) AS whole FROM {tag}_s s)"""


def high_loss_budget(tag: str, table: str, features: list[str], k: int, budget: int, niter: int, seed: int = 42) -> str:
    """CTE {tag}(domain, source, sample_id): small sources whole; of the rest quotas over the upper half of their clusters, highest loss first.

    What a source's clusters yield of a share is a fold over their sizes, packed with the number of clusters left into one whole number.
    """
    total = " + ".join(features)
    return f"""{shares(tag + '_g', table, budget)},
{tag}_t AS (SELECT t.*, least({k}, g.n_rows) AS k FROM {table} t JOIN {tag}_g g USING (domain, source) WHERE NOT whole),
{kmeans(tag + '_k', tag + '_t', features, niter, seed)},
{tag}_m AS (SELECT domain, source, cluster, count(*) AS size, CAST(sum({total}) AS DOUBLE) / (count(*) * {len(features)}) AS m FROM {tag}_k GROUP BY ALL),
{tag}_h AS (SELECT *, count(*) OVER (PARTITION BY domain, source) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY domain, source ORDER BY m DESC, cluster) AS rn, count(*) OVER (PARTITION BY domain, source) AS c FROM {tag}_m) WHERE rn <= greatest(1, floor(c * 0.5))),
{tag}_l AS (SELECT domain, source, list(size * 1000 + kept - rn + 1 ORDER BY rn) AS packed FROM {tag}_h GROUP BY domain, source),
{tag}_o AS (SELECT g.*, packed, row_number() OVER (ORDER BY n_rows, domain, source) AS j, count(*) OVER () AS n FROM {tag}_g g JOIN {tag}_l l USING (domain, source) WHERE NOT whole),
{tag}_b AS (
  SELECT CAST(0 AS BIGINT) AS j, CAST({budget} - (SELECT coalesce(sum(n_rows), 0) FROM {tag}_g WHERE whole) AS BIGINT) AS rest, '' AS domain, '' AS source, CAST(0 AS BIGINT) AS share
  UNION ALL
  SELECT j, CAST(rest - share + list_reduce(list_concat([share], packed), lambda a, x: a - least(x // 1000, a // (x % 1000))) AS BIGINT), domain, source, share
  FROM (SELECT o.j, b.rest, o.domain, o.source, o.packed, CAST(least(b.rest // (o.n - o.j + 1), o.n_rows) AS BIGINT) AS share FROM {tag}_b b JOIN {tag}_o o ON o.j = b.j + 1)),
{tag}_q AS (
  SELECT domain, source, CAST(0 AS BIGINT) AS i, share AS rest, CAST(0 AS BIGINT) AS cluster, CAST(0 AS BIGINT) AS quota FROM {tag}_b WHERE j > 0
  UNION ALL
  SELECT q.domain, q.source, h.rn, q.rest - least(h.size, q.rest // (h.kept - h.rn + 1)), h.cluster, CAST(least(h.size, q.rest // (h.kept - h.rn + 1)) AS BIGINT) FROM {tag}_q q JOIN {tag}_h h ON h.domain = q.domain AND h.source = q.source AND h.rn = q.i + 1),
{tag} AS (
  SELECT domain, source, sample_id FROM (SELECT a.domain, a.source, a.sample_id, q.quota, row_number() OVER (PARTITION BY a.domain, a.source, a.cluster ORDER BY md5('{seed}:' || a.sample_id), a.sample_id) AS r FROM {tag}_k a JOIN {tag}_q q ON q.domain = a.domain AND q.source = a.source AND q.cluster = a.cluster AND q.i > 0) WHERE r <= quota
  UNION ALL SELECT t.domain, t.source, t.sample_id FROM {table} t JOIN {tag}_g g USING (domain, source) WHERE whole)"""
