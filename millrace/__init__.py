"""millrace: DataFrame operators over language-model data, rewards and serving traces."""
