"""Named end-to-end plans over the driver tables, and their SQL oracles."""
