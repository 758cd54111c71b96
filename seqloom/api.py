"""The engine as a user calls it: pack once, then cluster at any identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .functions.residues import BANDS
from .operators import align, candidates, community, fast, report
from .operators.base import settled, written
from .sources import fasta, store


class SequenceEngine:
    """makedb packs a FASTA file or a table of texts; fast and clustering group what is packed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def makedb(self, path: str, fasta_path: str | None = None, table: DataFrame | None = None, **adapter) -> DataFrame:
        """Writes the packed data set to path and returns a row of statistics."""
        seqs = fasta.read_fasta(self.spark, fasta_path) if fasta_path else candidates.sequences_from_text(table, **adapter)
        stats = report.sequence_stats(seqs)
        if not stats.first()["valid"]:
            raise ValueError("no valid sequence")
        ranked = candidates.rank_by_length(seqs)
        signed = written(candidates.signatures(ranked), "signed")
        store.write_store(path, ranked, candidates.candidates(candidates.long_signatures(signed)), BANDS, signed)
        return stats

    def statistics(self, path: str, identity: int = 95, bands: int = BANDS) -> DataFrame:
        """One row about a first-hit run: valid, longest, shortest, compare_pairs, edges, clusters."""
        seqs, cand = self._load(path, identity, bands)
        hits = settled(align.edges(cand, seqs, identity))
        up = settled(fast.parents(cand, hits))
        return report.run_statistics(seqs, fast.compare_pairs(cand, up), hits, fast.assignments(seqs, fast.roots(up)))

    def _load(self, path: str, identity: int, bands: int) -> tuple[DataFrame, DataFrame]:
        candidates.check_parameters(identity, bands)
        store.check_store(self.spark, path)
        return store.read_store(self.spark, path, bands)

    def fast(self, path: str, identity: int = 95, bands: int = BANDS, result: str | None = None) -> DataFrame:
        """(idx, cluster_id) by first hits; writes the report to result if given."""
        seqs, cand = self._load(path, identity, bands)
        hits = settled(align.edges(cand, seqs, identity))
        return self._finish(fast.assignments(seqs, fast.roots(fast.parents(cand, hits))), seqs, result)

    def clustering(self, path: str, identity: int = 95, bands: int = BANDS, result: str | None = None, seed: int = 42) -> DataFrame:
        """(idx, cluster_id) by communities of the similarity graph; writes the report to result if given."""
        seqs, cand = self._load(path, identity, bands)
        hits = settled(align.edges(cand, seqs, identity))
        return self._finish(community.community_clusters(seqs, hits, identity, seed), seqs, result)

    def _finish(self, assigned: DataFrame, seqs: DataFrame, result: str | None) -> DataFrame:
        assigned = settled(assigned)
        if result:
            report.write_report(report.report_lines(assigned, seqs), result)
        return assigned
