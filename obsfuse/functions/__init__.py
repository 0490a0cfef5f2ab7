"""Column helpers.  Nothing here triggers a job."""
