"""Tables by layer with their lineage, report sinks, and adapters of public data sets."""
