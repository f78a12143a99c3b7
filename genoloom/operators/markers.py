"""Per-marker and per-animal statistics, Hardy-Weinberg tests, false discovery rates, sex checks, marker maps and panels."""

from __future__ import annotations

from ..plans.engine import register

# the exact test by one recurrence over the possible numbers of heterozygotes: first the largest and the observed
# log-probability, then the sums; k runs over numbers with the parity of the minor allele's count
_STEP = "ln(4e0 * ((rare - k) / 2) * (n_valid - k - (rare - k) / 2) / ((k + 2e0) * (k + 1e0)))"
# the first pass is bound to a variable, so that the optimiser can't repeat it for every element of the second
_HWE_SPARK = f"""select snp_idx, n0, n1, n2, n_valid, rare,
    transform(array(aggregate(sequence(rare % 2, rare, 2L), named_struct('l', 0D, 'm', 0D, 'o', 0D), (s, k) -> named_struct(
        'l', s.l + case when k < rare then {_STEP} else 0D end, 'm', greatest(s.m, s.l), 'o', case when k = n1 then s.l else s.o end))), top ->
      aggregate(sequence(rare % 2, rare, 2L), named_struct('l', 0D, 't', 0D, 'h', 0D), (s, k) -> named_struct(
        'l', s.l + case when k < rare then {_STEP} else 0D end, 't', s.t + exp(s.l - top.m), 'h', s.h + case when s.l <= top.o + 1e-9D then exp(s.l - top.m) else 0D end),
        s -> s.h / s.t))[0] as p
    from (select snp_idx, n0, n1, n2, n_valid, 2 * least(n0, n2) + n1 as rare from snp_counts) c"""
_LP = "(lgamma(n_valid + 1) - lgamma((rare - k) / 2 + 1) - lgamma(k + 1) - lgamma(n_valid - k - (rare - k) / 2 + 1) + k * ln(2e0))"
_HWE_DUCK = f"""select snp_idx, n0, n1, n2, n_valid, rare, sum(case when lp <= lo + 1e-9 then exp(lp - lo) else 0 end) / sum(exp(lp - lo)) as p from (
    select *, max(case when k = n1 then lp end) over (partition by snp_idx) as lo from (
      select *, {_LP} as lp from (select *, unnest(range(rare % 2, rare + 1, 2)) as k from (select snp_idx, n0, n1, n2, n_valid, 2 * least(n0, n2) + n1 as rare from snp_counts) c) e) d) t
    group by snp_idx, n0, n1, n2, n_valid, rare"""

register(
    {
        "snp_counts": """select snp_idx, cast(sum(case when g = 0 then 1 else 0 end) as bigint) as n0, cast(sum(case when g = 1 then 1 else 0 end) as bigint) as n1,
            cast(sum(case when g = 2 then 1 else 0 end) as bigint) as n2, count(g) as n_valid, count(*) as n_animals from geno group by snp_idx""",
        "snp_call_rate": "select snp_idx, round(n_valid * 1.0e0 / n_animals, 6) as call_rate from snp_counts",
        "snp_freqs": """select *, n_valid * 1.0e0 / n_animals as cr, case when n_valid > 0 then (2e0 * n0 + n1) / (2e0 * n_valid) else 0e0 end as fa,
            case when n_valid > 0 then (2e0 * n2 + n1) / (2e0 * n_valid) else 0e0 end as fb from snp_counts""",
        "allele_freq_maf": "select snp_idx, round(fa, 6) as freq_a, round(fb, 6) as freq_b, round(least(fa, fb), 6) as maf from snp_freqs",
        "monomorphic": "select snp_idx, least(fa, fb) = 0 as monomorphic from snp_freqs",
        "animal_rates": "select animal_id, count(g) as n_valid, count(*) as n_snps, count(g) * 1.0e0 / count(*) as cr from geno group by animal_id",
        "animal_call_rate": "select animal_id, n_valid, round(cr, 6) as call_rate from animal_rates",
        "autosome_mask": "select snp_idx, max(case when chr between 1 and $last_autosome then 1 else 0 end) as autosome from snp_map group by snp_idx",
        "x_snps": "select snp_idx, snp_id, pos from snp_map where chr = $x_chr",
        "hwe_raw": {"spark": _HWE_SPARK, "duckdb": _HWE_DUCK},
        "hwe_tests": "select snp_idx, n0, n1, n2, case when n_valid < $hwe_min_n or rare = 0 or rare < $hwe_min_mac then 1e0 else least(p, 1e0) end as p from hwe_raw",
        "hwe_exact": "select snp_idx, n0, n1, n2, round(p, 6) as p from hwe_tests",
        "bh_ranks": "select snp_idx, p, row_number() over (order by p, snp_idx) as k, count(*) over () as m from hwe_tests",
        "bh_fdr": "select snp_idx, round(least(1e0, min(p * m / k) over (order by k desc rows between unbounded preceding and current row)), 6) as p_adjusted from bh_ranks",
        # the order of the tests decides: not an autosome, monomorphic, call rate, minor allele frequency, Hardy-Weinberg
        "snp_quality": """select f.snp_idx, f.cr, least(f.fa, f.fb) as maf, h.p, a.autosome, case when a.autosome = 0 then 5 when least(f.fa, f.fb) = 0 then 2 when f.cr < $snp_cr then 4
            when least(f.fa, f.fb) < $min_maf then 1 when h.p < $hwe_alpha / t.n then 3 else 0 end as status
            from snp_freqs f join hwe_tests h on f.snp_idx = h.snp_idx join autosome_mask a on f.snp_idx = a.snp_idx cross join (select count(*) as n from snp_counts) t""",
        "snp_status": "select snp_idx, status from snp_quality",
        "snp_qc": "select snp_idx, round(cr, 6) as call_rate, round(maf, 6) as maf, round(p, 6) as hwe_p, autosome, status from snp_quality",
        "snp_qc_summary": """select status, count(*) as n, round(avg(cr), 6) as mean_cr, round(min(cr), 6) as min_cr, round(max(cr), 6) as max_cr, round(avg(maf), 6) as mean_maf,
            round(min(maf), 6) as min_maf, round(max(maf), 6) as max_maf from snp_quality group by status""",
        "x_freqs": "select x.snp_idx, case when f.n_valid > 0 then f.fa else 0.5e0 end as fa from x_snps x join snp_freqs f on x.snp_idx = f.snp_idx",
        "x_freq": "select snp_idx, round(fa, 6) as freq_a from x_freqs",
        "x_inbreeding": """select g.animal_id, count(*) as n_x, cast(sum(case when g.g = 1 then 1 else 0 end) as bigint) as n_het,
            case when count(*) >= $x_min and sum(2e0 * x.fa * (1 - x.fa)) > 0 then 1 - sum(case when g.g = 1 then 1e0 else 0e0 end) / sum(2e0 * x.fa * (1 - x.fa)) end as f
            from geno g join x_freqs x on g.snp_idx = x.snp_idx where g.g is not null group by g.animal_id""",
        "x_inbreeding_f": "select animal_id, n_x, n_het, round(f, 6) as f from x_inbreeding",
        "sex_checks": """select g.animal_id, p.sex, case when x.f is null then -1 when x.f > 0.8e0 then case when p.sex = 1 then 1 else 0 end
            when x.f < $female_f then case when p.sex = 2 then 1 else 0 end else 2 end as sex_qc from genotyped g left join ped p on g.animal_id = p.animal_id left join x_inbreeding x on g.animal_id = x.animal_id""",
        "sex_status": "select animal_id, sex, sex_qc from sex_checks",
        "array_all_rank": "select snp_id, chr, pos, row_number() over (order by chr, pos, snp_id) as array_all from snp_map",
        "array_chr_rank": "select snp_id, chr, pos, row_number() over (partition by chr order by pos, snp_id) as array_chr from snp_map",
        "validate_array_all": """select cast(sum(case when array_all = before then 1 else 0 end) as bigint) as duplicates, cast(sum(case when array_all > before + 1 then 1 else 0 end) as bigint) as gaps,
            cast(sum(case when array_all <= 0 then 1 else 0 end) as bigint) as not_positive from (select address as array_all, coalesce(lag(address) over (order by address), 0) as before from snp_addresses) o""",
        "validate_array_chr": """select chr, cast(sum(case when pos = before then 1 else 0 end) as bigint) as duplicates, cast(sum(case when snp_idx > last_idx + 18 then 1 else 0 end) as bigint) as gaps
            from (select chr, pos, snp_idx, lag(pos) over (partition by chr order by pos, snp_idx) as before, lag(snp_idx) over (partition by chr order by pos, snp_idx) as last_idx from snp_map) o group by chr""",
        "chrpos_lookup": """select k.chr, k.pos, m.array_all from (select chr, pos + (snp_idx % 3) as pos from snp_map) k left join array_all_rank m on k.chr = m.chr and k.pos = m.pos""",
        "seek_candidates": """select m.snp_idx, m.chr, m.pos, q.maf from (select *, row_number() over (partition by snp_idx order by snp_id) as copy from snp_map) m
            join snp_quality q on m.snp_idx = q.snp_idx where m.copy = 1 and q.autosome = 1 and q.cr >= $seek_cr and q.maf >= $seek_maf and q.p >= 0.001e0""",
        "seek_panel_filter": "select snp_idx, chr, pos, round(maf, 6) as maf from seek_candidates",
        **{f"{kind}bins": f"""select c.snp_idx, c.chr, c.pos, c.maf, b.quota, case when b.hi = b.lo then 1 else least(b.quota, 1 + cast(floor((c.pos - b.lo) * 1.0e0 * b.quota / (b.hi - b.lo)) as bigint)) end as bin
            from seek_candidates c join (select chr, min(pos) as lo, max(pos) as hi, greatest(1, cast(floor(count(*) * ${fraction} + 0.5e0) as bigint)) as quota from seek_candidates group by chr) b on c.chr = b.chr"""
            for kind, fraction in (("bp_", "panel_fraction"), ("id_", "id_fraction"))},
        **{panel: f"select snp_idx, chr, pos, bin, maf from (select *, row_number() over (partition by chr, bin order by maf desc, snp_idx) as k from {bins}) r where k = 1"
            for panel, bins in (("panel", "bp_bins"), ("id_panel", "id_bins"))},
        "bp_bin_topk": "select snp_idx, chr, bin, round(maf, 6) as maf from panel",
        "seek_profile": """select c.chr, count(*) as candidates, count(p.snp_idx) as selected, max(c.pos) - min(c.pos) as width from seek_candidates c
            left join panel p on c.snp_idx = p.snp_idx group by c.chr""",
        "geno_map": "select m.chr, count(*) as cells, count(g.g) as called, cast(sum(g.g) as bigint) as alleles from geno g join snp_map m on g.snp_idx = m.snp_idx group by m.chr",
        "geno_ped": "select a.animal_id, a.n_valid, p.sex, p.byr, p.breed from animal_rates a left join ped p on a.animal_id = p.animal_id",
    },
    {"last_autosome": 18, "x_chr": 20, "hwe_min_n": 20, "hwe_min_mac": 5, "snp_cr": "0.70e0", "min_maf": "0.01e0", "hwe_alpha": "0.05e0", "x_min": 10, "female_f": "0.02e0", "seek_cr": "0.99e0", "seek_maf": "0.30e0",
        "panel_fraction": "0.10e0", "id_fraction": "0.20e0"},
    {"snp_cr": "0.98e0", "min_maf": "0.12e0", "seek_cr": "0.95e0", "seek_maf": "0.15e0", "panel_fraction": "0.6e0", "id_fraction": "0.6e0"},
    steps=("snp_counts", "hwe_tests", "snp_quality", "panel", "id_panel", "sex_checks", "animal_rates", "x_freqs"),
)

QUERIES = [
    "snp_counts", "snp_call_rate", "allele_freq_maf", "monomorphic", "animal_call_rate", "autosome_mask", "x_snps", "hwe_exact", "bh_fdr", "snp_status", "snp_qc", "snp_qc_summary", "x_freq", "x_inbreeding_f",
    "sex_status", "array_all_rank", "array_chr_rank", "validate_array_all", "validate_array_chr", "chrpos_lookup", "seek_panel_filter", "bp_bin_topk", "seek_profile", "geno_map", "geno_ped",
]
