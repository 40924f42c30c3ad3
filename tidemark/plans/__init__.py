"""Driver-side plans: question resolution, mart gating and mart sets.

These modules only read column names, types and the counts of one shared
statistics pass; all data work is delegated to ``tidemark.operators``.
"""
