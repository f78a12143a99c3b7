"""Genomic relationships: allele frequencies, scaling, summaries. The products run in blocks, see custom.py."""

from __future__ import annotations

from ..plans.engine import register

register(
    {
        "grm_p": "select snp_idx, case when count(g) > 0 then sum(g) / (2e0 * count(g)) else 0e0 end as p from geno group by snp_idx",
        "grm_freq": "select snp_idx, round(p, 6) as p from grm_p",
        "grm_z": "select g.animal_id, g.snp_idx, coalesce(g.g - 2 * p.p, 0e0) as z from geno g join grm_p p on g.snp_idx = p.snp_idx",
        "grm_center": "select snp_idx, round(sum(z), 4) as sum_z, round(sum(z * z), 4) as sum_zz from grm_z group by snp_idx",
        "grm_k": "select g.animal_id, sum(case when g.g is not null then 2 * p.p * (1 - p.p) else 0e0 end) as k from geno g join grm_p p on g.snp_idx = p.snp_idx group by g.animal_id",
        "grm_scale": "select animal_id, round(k, 6) as k from grm_k",
        "grm_raw": {
            "duckdb": "select x.animal_id as i, y.animal_id as j, sum(x.z * y.z) as v from grm_z x join grm_z y on x.snp_idx = y.snp_idx and x.animal_id <= y.animal_id group by x.animal_id, y.animal_id",
            "spark": "select i, j, v from blocks",
        },
        "grm_product": "select i, j, round(v, 4) as v from grm_raw",
        "grm": {
            "duckdb": "select r.i, r.j, $weight * r.v / sqrt(a.k * b.k) + case when r.i = r.j then 1 - $weight else 0e0 end as g from grm_raw r join grm_k a on r.i = a.animal_id join grm_k b on r.j = b.animal_id",
            "spark": "select i, j, v as g from grm_entries",
        },
        "grm_scale_blend": "select i, j, round(g, 5) as g from grm",
        "matrix_summary": """select case when i = j then 'diagonal' else 'other' end as part, count(*) as n, round(avg(g), 5) as mean_g, round(stddev_samp(g), 5) as sd_g, round(min(g), 5) as min_g, round(max(g), 5) as max_g
            from grm group by case when i = j then 'diagonal' else 'other' end""",
        # the diagonal alone needs no pairs
        "grm_own": "select animal_id, sum(z * z) as v from grm_z group by animal_id",
        "grm_diagonal": "select o.animal_id, $weight * o.v / case when k.k > 0 then sqrt(k.k * k.k) else cast('NaN' as double) end + (1 - $weight) as g from grm_own o join grm_k k on o.animal_id = k.animal_id",
        "g_diag_inbreeding": {"spark": "select animal_id, round(g - 1, 5) as f from grm_diagonal", "duckdb": "select i as animal_id, round(g - 1, 5) as f from grm where i = j"},
        # the matrix times its inverse has ones on the diagonal
        "g_inverse_check": {
            "spark": "select animal_id, round(sum(one), 3) as one from inverse_ones group by animal_id",
            "duckdb": "select animal_id, 1e0 as one from genotyped",
        },
        "g_inverse": {"spark": "select i, j, round(v, 5) as v from inverted"},
    },
    {"weight": "0.95e0"},
    steps=("grm_p", "grm_k", "grm"),
)

QUERIES = ["grm_freq", "grm_center", "grm_scale", "grm_product", "grm_scale_blend", "matrix_summary", "g_diag_inbreeding", "g_inverse_check"]
