"""Fixed schemas of the stage tables, and the ordered cooperativity categories."""

REGIONS = "chrom string, start bigint, end bigint"
REGIONS_WITH_TARGET = REGIONS + ", target_reg double"
BED3, BED6 = "chrom string, start bigint, end bigint", "chrom string, start bigint, end bigint, name string, score string, strand string"
SIGNAL = "chrom string, start bigint, end bigint, value double"
HITS = "chrom string, start bigint, end bigint, details string"
PEAKS = "chrom string, start bigint, end bigint, detail string"
TILES = "chrom string, tile bigint, seq string"
COOPERATIVITY = "name string, abs_i_sum double, coop_score double, ks_p double, ks_d double, mw_p double, mw_d double, count bigint, mean_distance double, ks_q double, mw_q double, cooperativity string"

#: The categories in their order.
CATEGORIES = ["Independent", "Redundant", "Intermediate", "Synergistic"]
