"""railyard — DataFrame and Structured Streaming operators over the records a
distributed transport, shuffle service and job launcher produce.

Every operator takes DataFrames and returns DataFrames; nothing is collected to
the driver.  Sub-packages:

* ``functions``  – column-expression builders (hashing, slicing, splitting).
* ``operators``  – batch operators (projections, joins, aggregates, windows,
  text, arrays, keyed state) plus the shared skew-safe segmented scan.
* ``sources``    – readers and writers for the sample formats and layouts.
* ``streaming``  – Structured Streaming forms of the keyed-state operators.
* ``plans``      – bindings of the operators to the bundled test tables and the
  registry of named queries used by ``__spark_entry__``.
"""

from railyard.session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
