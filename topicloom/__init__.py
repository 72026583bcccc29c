"""topicloom: a PySpark engine that turns a corpus of short documents into labelled topic groups."""
