"""skarn subpackage."""
