"""Driver-side planning: guards, federation, agent flow."""
