"""Multi-step plans: stored intermediates, global ordering, end-to-end detection."""
