"""kestrel: analytics operators as Spark DataFrame jobs.

Sub-packages: `sources` (scans/sinks), `functions` (column expressions),
`operators` (DataFrame -> DataFrame operators), `plans` (registered queries
per case study), `streaming` (none needed).  See README.md.
"""

__version__ = "0.1.0"
