"""DuckDB SQL with the results of ``queries``, written on its own tables."""

from __future__ import annotations

from echofold.functions import constants as C
from echofold.operators.minhash import permutation_rows
from echofold.plans import queries as Q


def values(rows) -> str:
    return "(VALUES " + ",".join("(" + ",".join(repr(x) if isinstance(x, (int, float)) else f"'{x}'" for x in r) + ")" for r in rows) + ")"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


EVENTS = "s AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, CAST(value AS DOUBLE) AS value FROM events)"
VECTORS = "v AS (SELECT vec_id AS series_id, idx - 1 AS idx, CAST(embedding[idx] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS idx FROM embeddings))"


def slices(source: str, name: str, length: int, hop: int) -> str:
    return f"""{name} AS (SELECT s.series_id, f.slice_no, s.idx - f.slice_no * {hop} AS "offset", s.value
  FROM (SELECT series_id, unnest(range(0, (max(idx) + 1 - {length}) // {hop} + 1)) AS slice_no FROM {source} GROUP BY series_id HAVING max(idx) + 1 >= {length}) f
  JOIN {source} s ON s.series_id = f.series_id AND s.idx >= f.slice_no * {hop} AND s.idx < f.slice_no * {hop} + {length})"""


def matrix(name: str, m) -> str:
    return f"{name}(idx, o, w) AS (SELECT * FROM {values((int(i), int(o), float(m[o, i])) for o in range(len(m)) for i in range(len(m)) if m[o, i])})"


def _oracles() -> dict[str, str]:
    import numpy as np

    taps = f"taps(j, h) AS (SELECT * FROM {values((j, float(h)) for j, h in enumerate(C.fir_taps()))})"
    power = f"""p AS (SELECT series_id, k, sum(value * cos(2 * pi() * idx * k / {Q.VECTOR})) ^ 2 + sum(value * -sin(2 * pi() * idx * k / {Q.VECTOR})) ^ 2 AS power
  FROM v, (SELECT unnest(range(0, {Q.VECTOR // 2 + 1})) AS k) GROUP BY series_id, k)"""
    edges = Q.SPECTRUM_EDGES
    haar2 = [VECTORS, matrix("m", np.kron(C.haar_matrix(8), C.haar_matrix(8))), "c AS (SELECT series_id, o AS idx, sum(value * w) AS coeff FROM v JOIN m USING (idx) GROUP BY ALL)"]
    top = [*haar2, f"""t AS (SELECT * FROM (SELECT series_id, idx, round(coeff, 9) AS coeff, row_number() OVER (PARTITION BY series_id ORDER BY abs(round(coeff, 9)) DESC, idx) AS rank FROM c) WHERE rank <= {Q.TOP})"""]
    bits = "b AS (SELECT series_id, CASE WHEN coeff > 0.001 THEN 2 * idx ELSE 2 * idx + 1 END AS bit FROM t WHERE abs(coeff) > 0.001)"
    loud = f"q AS (SELECT series_id, count(*) FILTER (abs(coeff) > {Q.VECTOR_LOUD}) AS n_loud, count(*) FILTER (abs(coeff) > {Q.VECTOR_LOUD}) < {Q.VECTOR_LEAST} AS is_silence FROM t GROUP BY series_id)"

    def signature(bit_table: str, n_bits: int, n_perms: int, length: int) -> list[str]:
        return [
            f"perms(perm, rank, bit) AS (SELECT * FROM {values(permutation_rows(n_bits, n_perms, length))})",
            f"least AS (SELECT series_id, perm, min(rank) AS rank FROM {bit_table} JOIN perms USING (bit) GROUP BY ALL)",
            f"sig AS (SELECT i.series_id, p.perm, coalesce(l.rank, {length}) AS rank FROM (SELECT DISTINCT series_id FROM least) i CROSS JOIN (SELECT unnest(range(0, {n_perms})) AS perm) p LEFT JOIN least l ON l.series_id = i.series_id AND l.perm = p.perm)",
        ]

    vector_sig = [*top, loud, bits, "lb AS (SELECT b.* FROM b JOIN q USING (series_id) WHERE NOT is_silence)", *signature("lb", Q.BITS, Q.PERMS, Q.RANKS)]
    keys = "k AS (SELECT series_id, perm // 4 AS band_no, sum(CAST(rank AS BIGINT) * (256 ^ (3 - perm % 4))::BIGINT)::BIGINT AS band_key FROM sig GROUP BY ALL)"
    hexed = "SELECT series_id, string_agg(lower(lpad(to_hex(rank), 2, '0')), '' ORDER BY perm) AS signature FROM sig GROUP BY series_id"

    shingles = lambda t, i, n: f"""SELECT series_id, i, ('0x' || substr(md5(array_to_string(w[i:i + 2], ' ')), 1, 8))::BIGINT % {n} AS bit
  FROM (SELECT series_id, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT {i} AS series_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM {t} WHERE text IS NOT NULL))"""  # noqa: E731
    doc_sig = [f"bits AS (SELECT DISTINCT series_id, bit FROM ({shingles('documents', 'doc_id', Q.DOC_BITS)}))", *signature("bits", Q.DOC_BITS, Q.DOC_PERMS, C.NO_BIT)]
    doc_pairs = [*doc_sig, keys, f"cand AS (SELECT a.series_id AS query_id, b.series_id AS entry_id, count(*) AS n_bands FROM k a JOIN k b USING (band_no, band_key) WHERE a.series_id < b.series_id GROUP BY ALL HAVING count(*) >= {C.MIN_BANDS})"]

    ranks = C.rank_table(Q.PASSAGE_BITS)
    n, width = C.N_PERMUTATIONS, Q.PASSAGE_WIDTH
    sliding = ", ".join(f"min(r[{p}]) OVER w" for p in range(1, n + 1))
    windows = lambda t, i: f"""SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY i) - 1 AS sig_idx, sig FROM (
    SELECT series_id, i, [{sliding}] AS sig, max(i) OVER (PARTITION BY series_id) AS last FROM ({shingles(t, i, Q.PASSAGE_BITS)}) JOIN ranks USING (bit)
    WINDOW w AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING))
  WHERE (i - 1) % {Q.PASSAGE_HOP} = 0 AND i + {width - 1} <= last AND list_min(sig) < 255"""  # noqa: E731
    rank_rows = "ranks(bit, r) AS (SELECT * FROM (VALUES " + ",".join(f"({b},{row.tolist()})" for b, row in enumerate(ranks)) + "))"
    banded = lambda source: f"SELECT series_id, sig_idx, sig, b AS band_no, sig[4 * b + 1] * 16777216::BIGINT + sig[4 * b + 2] * 65536 + sig[4 * b + 3] * 256 + sig[4 * b + 4] AS band_key FROM (SELECT *, unnest(range(0, 25)) AS b FROM {source})"
    index = [rank_rows, f"ix AS MATERIALIZED ({windows('documents', 'doc_id')})"]

    def found(key: str = "band_key", extra: str = "") -> list[str]:
        return [
            *index,
            f"qs AS MATERIALIZED ({windows('benchmark', 'item_id')})",
            f"qb AS ({banded('qs')})",
            f"xb AS ({banded('ix')})",
            "size AS (SELECT greatest(1, count(*) // 2) AS size FROM ix)",
            f"runs AS (SELECT q.series_id AS query_id, q.sig_idx AS query_sig, x.series_id AS entry_id, x.sig_idx AS sig_idx, count(*) AS n_bands, any_value(q.sig) AS qh, any_value(x.sig) AS eh FROM (SELECT *, {key} AS kk FROM qb, size) q JOIN (SELECT *, {key} AS kk FROM xb, size) x ON q.band_no = x.band_no AND q.kk = x.kk GROUP BY ALL)",
            f"cand AS (SELECT * FROM runs WHERE n_bands >= {C.MIN_BANDS} {extra})",
            f"scored AS (SELECT query_id, query_sig, entry_id, sig_idx, n_bands, score FROM (SELECT *, len(list_filter(list_zip(qh, eh), lambda z: z[1] = z[2])) AS score FROM cand) WHERE score >= {C.MIN_SCORE})",
            "entries AS (SELECT query_id, entry_id, sum(score)::BIGINT AS score_sum, count(*) AS n_matches, sum(score) / count(*) AS average FROM scored GROUP BY ALL)",
            f"good AS (SELECT *, (n_matches >= {C.MIN_MATCHES} OR (average >= {C.GOOD_SCORE} AND n_matches >= {C.MIN_MATCHES // 2})) AND average >= {C.MIN_AVERAGE} AS ok FROM entries)",
            """lost AS (SELECT a.*, count(*) FILTER (b.entry_id <> a.entry_id AND CASE
    WHEN (floor(abs(a.average - b.average)) <= 3 AND (b.n_matches >= a.n_matches + 5 OR a.n_matches >= b.n_matches + 5)) OR (floor(abs(a.average - b.average)) < 1 AND a.n_matches <> b.n_matches) THEN b.n_matches > a.n_matches
    ELSE b.average > a.average END) AS losses FROM good a JOIN good b USING (query_id) GROUP BY ALL)""",
            f"ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY losses, average DESC, n_matches DESC, entry_id) AS rank FROM lost) WHERE rank <= {C.TOP_ENTRIES})",
            "best AS (SELECT query_id, entry_id, round(average, 6) AS average, n_matches FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY average DESC, rank) AS first FROM ranked WHERE ok) WHERE first = 1)",
        ]

    search = with_(*found())
    compat = with_(*found("band_key % size", "AND (entry_id, sig_idx) <> (SELECT (r2.entry_id, r2.sig_idx) FROM runs r2 WHERE r2.query_id = runs.query_id AND r2.query_sig = runs.query_sig ORDER BY r2.entry_id DESC, r2.sig_idx DESC LIMIT 1)"))
    out = {
        "rms_normalize": with_(EVENTS) + f" SELECT series_id, idx, round(greatest(-1, least(1, value / greatest({C.RMS_LOW}, least({C.RMS_HIGH}, {C.RMS_GAIN} * sqrt(avg(value * value) OVER (PARTITION BY series_id)))))), 6) AS y FROM s",
        "fir_decimate": with_(EVENTS, taps) + f" SELECT o.series_id, o.idx, round(sum(s.value * h), 6) AS y FROM (SELECT series_id, unnest(range(0, count(*) // {C.DECIMATION})) AS idx FROM s GROUP BY series_id) o JOIN taps ON true JOIN s ON s.series_id = o.series_id AND s.idx = o.idx * {C.DECIMATION} + j GROUP BY ALL",
        "hann_window": with_(VECTORS) + f" SELECT series_id, idx, round(value * 0.5 * (1 - cos(2 * pi() * idx / {Q.VECTOR - 1})), 6) AS y FROM v",
        "frame_counts": with_(EVENTS, f"f AS (SELECT series_id, count(*) AS n_samples, CASE WHEN count(*) >= {Q.FRAME} THEN 1 + (count(*) - {Q.FRAME}) // {Q.HOP} ELSE 0 END AS n_frames FROM s GROUP BY series_id)", f"g AS (SELECT *, CASE WHEN n_frames >= {Q.WIDTH} THEN 1 + (n_frames - {Q.WIDTH}) // {Q.IMAGE_HOP} ELSE 0 END AS n_images FROM f)") + " SELECT *, CASE WHEN n_images = 0 THEN 'FILE_TOO_SMALL' END AS status FROM g",
        "frame_slices": with_(EVENTS, slices("s", "f", Q.FRAME, Q.HOP)) + ' SELECT series_id, slice_no, "offset", round(value, 6) AS value FROM f',
        "image_slices": with_(EVENTS, slices("s", "f", Q.FRAME, Q.HOP), "m AS (SELECT series_id, slice_no AS idx, avg(value) AS value FROM f GROUP BY ALL)", slices("m", "g", Q.WIDTH, Q.IMAGE_HOP)) + ' SELECT series_id, slice_no, "offset", round(value, 6) AS value FROM g',
        "dft_power": with_(VECTORS, power) + " SELECT series_id, k, round(power, 6) AS power FROM p",
        "log_bins": with_(VECTORS, power, f"e(bin, lo, hi) AS (SELECT * FROM {values((i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))})") + " SELECT series_id, bin, round(avg(power), 6) AS mean_power FROM p JOIN e ON k >= lo AND k < hi GROUP BY ALL",
        "log_bin_edges": f"SELECT i::INT AS edge, greatest(1, least(1024, floor(1024 * {C.LOW_HZ} * ({C.HIGH_HZ} / {C.LOW_HZ}) ^ (i / {C.N_BINS}.0) / {C.NYQUIST_HZ} + 0.5)))::INT AS place FROM range(0, {C.N_BINS + 1}) t(i)",
        "image_scale": with_(VECTORS, "m AS (SELECT *, max(abs(value)) OVER (PARTITION BY series_id) AS top FROM v)") + " SELECT series_id, idx, CASE WHEN top > 0 THEN round(ln(1 + least(255, 255 * abs(value) / top)) / ln(256), 6) ELSE 0 END AS scaled FROM m",
        "haar_1d": with_(VECTORS, matrix("m", C.haar_matrix(Q.VECTOR))) + " SELECT series_id, o AS idx, round(sum(value * w), 6) AS coeff FROM v JOIN m USING (idx) GROUP BY ALL",
        "haar_2d": with_(*haar2) + " SELECT series_id, idx, round(coeff, 6) AS coeff FROM c",
        "topk_wavelets": with_(*top) + " SELECT series_id, idx, round(coeff, 6) AS coeff, rank FROM t",
        "sign_bits": with_(*top, bits) + " SELECT * FROM b",
        "silence_flags": with_(*top, loud) + " SELECT * FROM q",
        "minhash_signatures": with_(*vector_sig) + " SELECT series_id, perm, rank FROM sig",
        "signature_hex": with_(*vector_sig) + f" {hexed}",
        "band_keys": with_(*vector_sig, keys) + " SELECT * FROM k",
        "band_bucket_mod": with_(*vector_sig, keys) + " SELECT band_no, band_key % (SELECT greatest(1, count(DISTINCT series_id) // 2) FROM k) AS bucket, count(*) AS n_signatures FROM k GROUP BY ALL",
        "document_signatures": with_(*doc_sig) + f" SELECT series_id AS doc_id, signature FROM ({hexed})",
        "lsh_candidates": with_(*doc_pairs) + " SELECT * FROM cand",
        "pair_scores": with_(*doc_pairs) + f" SELECT query_id, entry_id, n_bands, count(*) FILTER (x.rank = y.rank) AS score FROM cand JOIN sig x ON x.series_id = query_id JOIN sig y ON y.series_id = entry_id AND y.perm = x.perm GROUP BY ALL HAVING count(*) FILTER (x.rank = y.rank) >= {Q.DOC_MIN_SCORE}",
        "database_stats": with_(*index) + " SELECT series_id AS entry_id, count(*) AS n_signatures FROM ix GROUP BY series_id",
        "passage_pairs": search + " SELECT * FROM scored",
        "entry_scores": search + " SELECT query_id, entry_id, score_sum, n_matches, round(average, 6) AS average FROM entries",
        "qualified_entries": search + " SELECT query_id, entry_id, score_sum, n_matches, round(average, 6) AS average FROM good WHERE ok",
        "rank_entries": search + " SELECT query_id, entry_id, score_sum, n_matches, round(average, 6) AS average, losses, rank FROM ranked",
        "best_match": search + " SELECT best.*, d.lang, d.source FROM best JOIN documents d ON d.doc_id = entry_id",
        "identify_passage": search + " SELECT item_id AS query_id, entry_id, average, n_matches FROM benchmark LEFT JOIN best ON query_id = item_id",
        "search_compat": compat + " SELECT * FROM best",
        "metadata_parse": "SELECT page_id, regexp_extract(url, '://([^/]*)', 1) AS artist, regexp_extract(url, '://[^/]*(/[^?#]*)', 1) AS title, regexp_extract(url, '\\?(.*)$', 1) AS album FROM pages",
        "stream_dedup": "SELECT stream_id, window_no, entry_id FROM (SELECT *, lag(entry_id) OVER (PARTITION BY stream_id ORDER BY window_no) AS before FROM (SELECT * FROM (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS window_no, CASE WHEN event_type <> 'purchase' THEN event_type END AS entry_id FROM events) WHERE entry_id IS NOT NULL)) WHERE before IS NULL OR before <> entry_id",
    }
    # rounding can give -0.0, which is made 0.0 as in the queries
    for column, names in (("y", "rms_normalize fir_decimate hann_window"), ("value", "frame_slices image_slices"), ("power", "dft_power"), ("mean_power", "log_bins"), ("scaled", "image_scale"), ("coeff", "haar_1d haar_2d topk_wavelets")):
        for n in names.split():
            out[n] = f"SELECT * REPLACE ({column} + 0.0 AS {column}) FROM ({out[n]})"
    return out


ORACLES = _oracles()
