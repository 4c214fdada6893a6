"""Where records come from and where state is kept."""
