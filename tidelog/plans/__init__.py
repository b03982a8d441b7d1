"""The fluent API: topologies of streams that become one logical plan per terminal."""
