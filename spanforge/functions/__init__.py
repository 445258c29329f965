"""spanforge.functions"""
