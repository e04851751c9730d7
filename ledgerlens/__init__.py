"""ledgerlens — billing audit analytics on Spark.

Reports are DataFrame → DataFrame functions in ``ledgerlens.plans``
(billing, anomaly, tagging, freight, recovery); inputs come from
``ledgerlens.sources`` and the incremental monitor lives in
``ledgerlens.streaming``.
"""

__version__ = "0.1.0"
