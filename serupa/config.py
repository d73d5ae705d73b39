"""Settings shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Results depend on them.
    abstract_max_chars: int = 300
    stopword_df: float = 0.15
    weight_title: float = 0.7
    weight_abstract: float = 0.2
    weight_keywords: float = 0.1
    hybrid_semantic: float = 0.7
    hybrid_lexical: float = 0.3
    title_min_chars: int = 5
    title_max_chars: int = 500
    year_min: int = 1990
    year_max: int = 2100
    top_k_default: int = 5
    top_k_max: int = 20
    threshold_default: float = 0.5
    level_bounds: tuple = ((0.85, "SANGAT TINGGI"), (0.70, "TINGGI"), (0.50, "SEDANG"))
    level_lowest: str = "RENDAH"
    default_type: str = "skripsi"
    unknown_program: str = "Tidak Diketahui"
    job_error_max_chars: int = 2000
    eval_target: float = 0.65

    # Physical limits: they choose a strategy, never a result.
    broadcast_bytes: int = 64 << 20  # query vectors shipped to every task
    broadcast_rows: int = 500_000  # narrow id tables shipped to every task
    shipped_pairs: int = 20_000  # pairs found that are scored with both word sets in their row
    tile_rows: int = 262_144  # rows of one side of a vector tile, and
    tile_bytes: int = 128 << 20  # their vectors as doubles
    copied_bytes: int = 8 << 30  # copies at once, of vectors for the tiles they meet or of texts for their pairs; more if
    copied_times: int = 2  # so many times both sides of vectors, or all texts once, are more
    literal_words: int = 10_000  # dynamic stopwords inlined in the plan

    def rows_a_tile(self, dim: int) -> int:
        return max(1, min(self.tile_rows, self.tile_bytes // (8 * dim)))


DEFAULTS = Settings()
