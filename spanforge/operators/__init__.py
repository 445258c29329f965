"""spanforge.operators"""
