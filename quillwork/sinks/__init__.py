"""Writers and dataset export formats."""
