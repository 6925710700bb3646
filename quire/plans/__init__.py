"""End-to-end jobs composed from operators, and the bindings of every operator
to the driver tables (``catalog``)."""
