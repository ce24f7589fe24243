"""Sources and sinks: driver tables, TEI XML, CSV, tagged tokens, vocabularies."""
