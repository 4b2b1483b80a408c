"""Where tables come from and where results are kept."""
