"""Plan shapes that the operators share."""
