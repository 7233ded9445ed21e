"""No streaming operators: the work is bounded batch (see README).

The logit scores in ``driftgauge.functions.scores`` are plain column expressions and
accept a streaming DataFrame as they are.
"""
