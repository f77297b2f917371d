"""Where lakes come from and results go."""
