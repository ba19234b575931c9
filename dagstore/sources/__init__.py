"""Sources and sinks: framed logs, packs with their indexes, upstream exports, metric texts, the cold tier."""
